"""Quality classifier: random-indexing word vectors and a small network.

Word vectors: every word of the corpus gathers the index vectors (sparse, signed,
fixed by hash) of the words around it, over all documents; words share
``WORD_ROWS`` hashed rows, so the table has one size whatever the corpus. Counts
and vectors are summed inside each task and sent on in blocks of rows.

A document is pooled to the mean and the spread of its words' vectors (scaled to
unit length, without the corpus mean, frequent words damped) and a few lengths.
A two-layer network in numpy is fitted on a bounded labelled sample
(``sample.ROWS_PER_CLASS``, ``sample.MAX_BYTES``), its probabilities are divided
by a temperature fitted on a part of the sample left out of the fit.

Words here are runs of letters and digits (by case: lower, Capital, UPPER) and
runs of other visible characters, so that markup and shouting are words too.

Defined cases: null and empty texts pool to zeros and are scored as such; without
labelled rows of both classes every score is the share of label 1 (0 without
labels); copies and repeated rows score alike; an empty table gives an empty
result; other columns pass through, an input column ``score`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, NOT_SPACE, SpanHash, mixed, pieces, saved, table, text_bytes, word_spans
from .sample import labelled_sample, remainder

WORD_ROWS, SIZE, BLOCK = 1 << 14, 32, 1 << 7
SALTS = 32
NEAR = 2  # words on either side
HIDDEN, EPOCHS, LEARNING, HELD = 24, 60, 0.01, 0.2
PART = 2 << 20
KEEP = 0.7

# Byte classes (letters and digits with all non-ASCII; the rest that is visible).
_LETTER = ALNUM.copy()
_LETTER[0x41:0x5B] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def words_of(data, ends, hasher):
    """Row and hashed table row of each word, in order. A word's hash covers its
    lower-cased bytes and its case (first byte and last byte upper or not)."""
    letters, marks = _LETTER[data], NOT_SPACE[data] & ~_LETTER[data]
    a0, b0, r0 = word_spans(letters, ends)
    a1, b1, r1 = word_spans(marks, ends)
    a, b, r = np.concatenate((a0, a1)), np.concatenate((b0, b1)), np.concatenate((r0, r1))
    order = np.argsort(a, kind="stable")
    a, b, r = a[order], b[order], r[order]
    sums = hasher.prefix(LOWER[data])
    case = _UPPER[data[a]].astype(np.uint64) * np.uint64(2) + _UPPER[data[b - 1]].astype(np.uint64)
    h = mixed(hasher.spans(sums, a, b) + case)
    return r, (h % np.uint64(WORD_ROWS)).astype(np.int64), h


def index_vector(h: np.ndarray):
    """The two places of a word's index vector and their signs."""
    a, b = (h >> np.uint64(20)) % np.uint64(SIZE), (h >> np.uint64(30)) % np.uint64(SIZE)
    signs = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1, ((h >> np.uint64(41)) & np.uint64(1)).astype(np.int64) * 2 - 1
    return (a.astype(np.int64), signs[0]), (b.astype(np.int64), signs[1])


def _gather(batches):
    """Sums over a task's texts, sent as blocks of rows: counts, then vectors."""
    vectors = np.zeros(WORD_ROWS * SIZE)
    counts = np.zeros(WORD_ROWS, np.int64)
    hasher = SpanHash()
    for piece in pieces(batches, "text", PART):
        row, word, h = words_of(*text_bytes(piece.column(0)), hasher)
        counts += np.bincount(word, minlength=WORD_ROWS)
        for place, sign in index_vector(h):
            for d in range(1, NEAR + 1):
                same = np.flatnonzero(row[d:] == row[:-d])
                for to, of in ((same, same + d), (same + d, same)):
                    vectors += np.bincount(word[to] * SIZE + place[of], weights=sign[of], minlength=WORD_ROWS * SIZE)
    if counts.any():
        both = np.concatenate((counts[:, None].astype(float), vectors.reshape(WORD_ROWS, SIZE)), axis=1).reshape(-1, BLOCK, SIZE + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(both)), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in both], pa.binary())], ["block", "sums"])


def _add(batches):
    """Sums of equal blocks; a task holds one total for each of its blocks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if block not in total:
                total[block] = np.zeros(BLOCK * (SIZE + 1))
            total[block] += np.frombuffer(one.as_buffer(), np.float32)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["block", "sums"])


class WordTable:
    """Vectors of the hashed words, centred, of unit length, damped by share."""

    def __init__(self, sums: np.ndarray):
        counts, vectors = sums[:, 0], sums[:, 1:]
        seen = counts > 0
        vectors = vectors / np.maximum(counts, 1)[:, None]
        if seen.any():
            vectors = vectors - np.average(vectors[seen], axis=0, weights=counts[seen])
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        share = counts / max(1.0, counts.sum())
        weight = 1e-2 / (1e-2 + share)  # frequent words count less
        self.vectors = (vectors / np.maximum(norm, 1e-9) * weight[:, None] * seen[:, None]).astype(np.float32)

    def pool(self, data, ends, hasher) -> np.ndarray:
        """Per row: mean and spread of the words' vectors, and lengths."""
        rows = len(ends) - 1
        row, word, h = words_of(data, ends, hasher)
        n = np.bincount(row, minlength=rows)
        out = np.zeros((rows, 2 * SIZE + 3), np.float64)
        some = np.flatnonzero(n)
        if len(some):
            first = (np.cumsum(n) - n)[some]
            v = self.vectors[word]
            mean = np.add.reduceat(v, first, axis=0) / n[some][:, None]
            square = np.add.reduceat(v * v, first, axis=0) / n[some][:, None]
            out[some, :SIZE] = mean
            out[some, SIZE: 2 * SIZE] = np.sqrt(np.maximum(square - mean * mean, 0))
            again = np.zeros(len(row), bool)  # the same word as one of the two before it
            for d in (1, 2):
                again[d:] |= (h[d:] == h[:-d]) & (row[d:] == row[:-d])
            out[some, 2 * SIZE] = np.log1p(n[some]) / 8
            out[some, 2 * SIZE + 1] = np.bincount(row, weights=again, minlength=rows)[some] / n[some]
            out[some, 2 * SIZE + 2] = (np.diff(ends)[some] / n[some]) / 10
        return out


def word_table(docs: DataFrame, text: str = "text") -> WordTable:
    """Vectors from all documents; the driver gets the finished table only
    (``WORD_ROWS`` rows, the same for any corpus)."""
    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks = own.mapInArrow(_gather, "block int, sums binary")
    part = blocks.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("block", "salt")
    part = part.select("block", "sums").mapInArrow(_add, "block int, sums binary")
    total = saved(part.repartition("block").mapInArrow(_add, "block int, sums binary"))
    sums = np.zeros((WORD_ROWS // BLOCK, BLOCK, SIZE + 1))
    for r in total.toLocalIterator():
        sums[r["block"]] = np.frombuffer(bytes(r["sums"]), np.float32).reshape(BLOCK, SIZE + 1)
    return WordTable(sums.reshape(WORD_ROWS, SIZE + 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """tanh layer and logistic output, fitted by Adam with balanced classes; the
    temperature is fitted on rows left out."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.0
        self.fitted = len(set(y.tolist())) == 2 and len(y) >= 20
        if not self.fitted:
            return
        rng = np.random.default_rng(7)
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.centre) / self.scale
        order = rng.permutation(len(y))
        held, fit = order[: int(HELD * len(y))], order[int(HELD * len(y)):]
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m, s = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        t = 0
        for epoch in range(EPOCHS):
            rate = LEARNING * (1 - epoch / EPOCHS)
            for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                t += 1
                hidden = np.tanh(x[batch] @ self.w[0] + self.w[1])
                gap = (_sigmoid(hidden @ self.w[2] + self.w[3]) - y[batch]) / len(batch)
                below = gap[:, None] * self.w[2] * (1 - hidden * hidden)
                grads = [x[batch].T @ below + 1e-4 * self.w[0], below.sum(axis=0), hidden.T @ gap + 1e-4 * self.w[2], np.array([gap.sum()])]
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
        logit = self._logit(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        p = np.clip(_sigmoid(logit[None, :] / grid[:, None]), 1e-9, 1 - 1e-9)
        loss = -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean(axis=1)
        self.temperature = float(grid[np.argmin(loss)])

    def _logit(self, x):
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return _sigmoid(self._logit((x - self.centre) / self.scale) / self.temperature)


class Model:
    def __init__(self, words: WordTable, texts: list[str], labels: list[int]):
        self.words = words
        hasher = SpanHash()
        pooled = [words.pool(*text_bytes(pa.array(texts[a: a + 256], pa.large_string())), hasher) for a in range(0, len(texts), 256)]
        x = np.concatenate(pooled) if pooled else np.zeros((0, 2 * SIZE + 3))
        self.network = Network(x, np.array(labels, np.int64))

    def score(self, data, ends, hasher) -> np.ndarray:
        return self.network.score(self.words.pool(data, ends, hasher))


def fit(docs: DataFrame, labels: DataFrame, allowed) -> Model:
    """Word vectors of all documents, network of the bounded labelled sample."""
    return Model(word_table(docs), *labelled_sample(docs, labels, "quality", allowed))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score: the calibrated probability of label 1."""
    own = docs.drop("score")
    own = own.withColumn(text, F.col(text).cast("string"))
    names, held = own.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher = SpanHash()
        for piece in pieces(batches, text, PART):
            s = held.value.score(*text_bytes(piece.column(names.index(text))), hasher)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(s, pa.float64())], [*names, "score"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())]))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Contract query: ids with crc32 mod 4 = 2 are held out; all are scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= KEEP).cast("int").alias("predicted"))
