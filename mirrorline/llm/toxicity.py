"""Toxicity by a linear-chain conditional random field over words.

Labels are given per document, so words are labelled first: in a toxic document
a word is toxic if it, or its first bytes, occur in toxic documents far more
often than in clean ones. The chain (two states per word, sentences as chains)
is then fitted to these labelled words; its weights belong to words and word
beginnings (by 64-bit hash). Forward-backward marginals are combined per document to the chance that some word is
toxic, calibrated on the sample with the classes weighted as the labels have them,
and words whose marginal is at least one half give the offending offsets.

The fit uses a bounded sample of labelled rows (``sample.ROWS_PER_CLASS``,
``sample.MAX_BYTES``); scoring reads every whole text, in Arrow batches.

Defined cases: null and empty texts have no words and score as the fitted model
does for no evidence; without labelled rows of both classes, or without a word
that lifts, every score is the share of label 1 (0 without labels); copies and repeated rows score alike; an
empty table gives an empty result. Other columns pass through; input columns
named ``score`` and ``toxic_spans`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, SpanHash, char_starts, mixed, pieces, table, text_bytes, word_spans
from .sample import remainder, weighted_sample

LEAST_WEIGHT = 0.1  # features of less weight are left out of the fitted model
BEGINNINGS = (5, 7)  # bytes of a word that are features beside the whole word
ROUNDS, RATE, DECAY = 14, 0.7, 1e-4
MIN_ROWS, MIN_LIFT, CHANCE = 4, 12.0, 0.3  # CHANCE: types expected to pass by chance alone

# Bytes that end a sentence.
SENTENCE_END = np.zeros(256, dtype=bool)
SENTENCE_END[[0x2E, 0x21, 0x3F, 0x0A]] = True


class Words:
    """The words of some texts with their features and chains."""

    def __init__(self, data, ends, hasher: SpanHash):
        low = LOWER[data]
        self.starts, self.stops, self.row = word_spans(ALNUM[low], ends)
        sums = hasher.prefix(low)
        self.word = hasher.spans(sums, self.starts, self.stops)
        self.kinds = [self.word]
        for b in BEGINNINGS:  # a word that is no longer than the beginning has only itself
            longer = self.stops - self.starts > b
            self.kinds.append(np.where(longer, hasher.spans(sums, self.starts, np.minimum(self.stops, self.starts + b)), ~self.word))
        n = len(self.row)
        ends_before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(SENTENCE_END[data], out=ends_before[1:])
        new = np.ones(n, dtype=bool)
        if n:
            new[1:] = (self.row[1:] != self.row[:-1]) | (ends_before[self.starts[1:]] > ends_before[self.stops[:-1]])
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.concatenate((self.first, [n])))

    @classmethod
    def joined(cls, texts: list[str], size: int = 1 << 19) -> "Words":
        """The words of many texts, hashed a few at a time (without positions)."""
        hasher, parts, at, rows = SpanHash(), [], 0, 0
        for piece in pieces([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])], "text", size):
            w = cls(*text_bytes(piece.column(0)), hasher)
            parts.append(((w.row + rows).astype(np.int32), w.first + at, w.length, *w.kinds))
            at, rows = at + len(w.word), rows + piece.num_rows
        out = cls.__new__(cls)
        out.row, out.first, out.length, *out.kinds = (np.concatenate(x) for x in zip(*parts, strict=True))
        out.word = out.kinds[0]
        return out


def marginals(emission, first, length, move):
    """Forward-backward over many chains at once: the ratio of state 1 to state
    0 seen from the left, and from the right. ``move``: exp of the transition
    weights, [from, to]. Chains step together, the longest first."""
    n = len(emission)
    e = np.exp(np.clip(emission, -30, 30))
    left, right = np.empty(n), np.empty(n)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), side="left")  # chains longer than each step
    r = q = None
    for t in range(steps):
        k = alive[t]
        at = first[:k] + t
        r = e[at] if t == 0 else e[at] * (move[0, 1] + r[:k] * move[1, 1]) / (move[0, 0] + r[:k] * move[1, 0])
        left[at] = r
    for t in range(steps):
        k = alive[t]
        at = first[:k] + length[:k] - 1 - t
        if t == 0:
            q = np.ones(k)
        else:
            w = e[at + 1] * q[:k]
            q = (move[1, 0] + move[1, 1] * w) / (move[0, 0] + move[0, 1] * w)
        right[at] = q
    return left, right


def _toxic_words(words: Words, y: np.ndarray, features: list) -> np.ndarray:
    """Word labels: in toxic rows, words whose type (or beginning) lifts. A type
    counts once for each pair of neighbouring words and once a row, so that
    copies of a text and words repeated in one text add nothing. Rows with a
    labelled word are explained; the others are searched again on their own,
    where rarer words stand out, until nothing is found. ``features``: the types
    of each kind, and the type of each word."""
    near = np.zeros(len(words.row), np.uint64)
    near[1:] += words.word[:-1] * np.uint64(3)
    near[:-1] += words.word[1:] * np.uint64(5)

    def rows_of(kind, of, size, side):
        _, at = np.unique(near[side] ^ mixed(kind[side]), return_index=True)
        in_rows = np.unique(of[side][at].astype(np.int64) * len(y) + words.row[side][at])
        return np.bincount(in_rows // len(y), minlength=size)

    clean = [rows_of(kind, of, len(types), y[words.row] == 0) for kind, (types, of) in zip(words.kinds, features, strict=True)]
    n0 = max(1, int((y == 0).sum()))
    out = np.zeros(len(words.row), dtype=bool)
    unexplained = y == 1
    while unexplained.any():
        n1 = int(unexplained.sum())
        share, side = n1 / (n1 + n0), unexplained[words.row]
        new = np.zeros(len(words.row), dtype=bool)
        for kind, (types, of), b in zip(words.kinds, features, clean, strict=True):
            a = rows_of(kind, of, len(types), side)
            lift = (a / n1) / ((b + 0.5) / n0)
            n = a + b
            p = np.clip(a / np.maximum(n, 1), 1e-9, 1 - 1e-9)
            surprise = n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))  # Chernoff's bound
            new |= ((a >= MIN_ROWS) & (lift >= MIN_LIFT) & (surprise >= np.log(len(types) / CHANCE)))[of]
        new &= (y == 1)[words.row]
        found = np.bincount(words.row[new], minlength=len(y)) > 0
        if not (found & unexplained).any():
            break
        out |= new
        unexplained &= ~found
    return out


class Model:
    """Chain weights and the calibration of document scores."""

    def __init__(self, texts: list[str], labels: list[int], weights: list[float] | None = None):
        y = np.array(labels, np.int64)
        weight = np.ones(len(y)) if weights is None else np.array(weights, float)
        self.prior = float(np.average(y, weights=weight)) if len(y) else 0.0
        self.fitted = len(set(labels)) == 2
        if not self.fitted:
            return
        words = Words.joined(texts)
        features = [(types, of.astype(np.int32)) for types, of in (np.unique(kind, return_inverse=True) for kind in words.kinds)]
        target = _toxic_words(words, y, features).astype(float)
        self.fitted = bool(target.any())
        if not self.fitted:
            return
        self._fit_chain(words, target, features)
        self._calibrate(self._evidence(words, len(y)), y, weight)

    def _fit_chain(self, words, target, features):
        self.bias, weights = -4.0, [np.zeros(len(types)) for types, _ in features]
        self.move = np.zeros((2, 2))
        squares = [np.full(len(types), 1e-6) for types, _ in features]
        counts = [np.bincount(of, minlength=len(types)) for types, of in features]
        inner = np.ones(len(target), dtype=bool)
        inner[words.first] = False
        to = np.flatnonzero(inner)
        seen = 2 * target[to - 1] + target[to]
        observed = np.bincount(seen.astype(int), minlength=4).reshape(2, 2)
        for _ in range(ROUNDS):
            move = np.exp(self.move)
            emission = self.bias + sum(w[of] for w, (_, of) in zip(weights, features, strict=True))
            left, right = marginals(emission, words.first, words.length, move)
            odds = left * right
            gap = target - odds / (1 + odds)
            for w, (_, of), count, sq in zip(weights, features, counts, squares, strict=True):
                step = np.bincount(of, weights=gap, minlength=len(w)) - DECAY * count * w
                sq += step * step
                w += RATE * 2 * step / np.sqrt(sq)
            self.bias += RATE * float(np.clip(gap.mean() * 20, -1, 1))
            if len(to):  # expected transitions
                w = np.exp(np.clip(emission[to], -30, 30)) * right[to]
                r = left[to - 1]
                parts = np.stack((np.full(len(to), move[0, 0]), move[0, 1] * w, r * move[1, 0], r * move[1, 1] * w))
                expected = (parts / parts.sum(axis=0)).sum(axis=1).reshape(2, 2)
                step = (observed - expected) / (observed + expected + 10)
                step[0, 0] = 0.0  # the fixed reference
                self.move += 0.5 * step
        self.weights = []
        for w, (types, _) in zip(weights, features, strict=True):
            kept = np.abs(w) >= LEAST_WEIGHT
            kept[0] = True
            self.weights.append((types[kept], w[kept]))

    def word_marginals(self, words: Words) -> np.ndarray:
        emission = np.full(len(words.row), self.bias)
        for kind, (types, weights) in zip(words.kinds, self.weights, strict=True):
            at = np.minimum(np.searchsorted(types, kind), len(types) - 1)
            emission += np.where(types[at] == kind, weights[at], 0.0)
        left, right = marginals(emission, words.first, words.length, np.exp(self.move))
        odds = left * right
        return odds / (1 + odds)

    def _evidence(self, words, rows, p=None):
        """Per row: logit that some word is toxic, from marginals over a quarter
        (the many small ones of a long clean text would add up to one)."""
        p = self.word_marginals(words) if p is None else p
        none = np.bincount(words.row, weights=np.where(p > 0.25, np.log1p(-np.minimum(p, 1 - 1e-9)), 0.0), minlength=rows)
        some = np.clip(-np.expm1(none), 1e-3, 1 - 1e-3)
        return np.log(some / (1 - some))[:, None]

    def _calibrate(self, x, y, weight):
        """Logistic regression by Newton steps, with classes as the labels have
        them: the sample may hold other shares of them."""
        weight = weight / weight.mean()
        x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
        w = np.zeros(2)
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * (p * (1 - p) + 1e-3))[:, None]).T @ x + 1e-2 * np.eye(2)
            w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
        self.calibration = w

    def score(self, data, ends, hasher: SpanHash):
        """Scores per row, and offending words: (row, byte start, byte end)."""
        rows = len(ends) - 1
        if not self.fitted:
            return np.full(rows, self.prior), np.zeros((0, 3), np.int64)
        words = Words(data, ends, hasher)
        p = self.word_marginals(words)
        x = self._evidence(words, rows, p)
        s = 1 / (1 + np.exp(-np.clip(x[:, 0] * self.calibration[0] + self.calibration[1], -30, 30)))
        bad = np.flatnonzero(p >= 0.5)
        return s, np.stack((words.row[bad], words.starts[bad], words.stops[bad]), axis=1)


def fit(docs: DataFrame, labels: DataFrame, allowed) -> Model:
    """The model of a bounded labelled sample (see ``sample``)."""
    return Model(*weighted_sample(docs, labels, "toxic", allowed))


_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def tag(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (double) and toxic_spans (character start and end)."""
    own = docs.drop("score", "toxic_spans")
    own = own.withColumn(text, F.col(text).cast("string"))
    names, held = own.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher = SpanHash()
        for piece in pieces(batches, text):
            data, ends = text_bytes(piece.column(names.index(text)))
            score, bad = held.value.score(data, ends, hasher)
            spans = [[] for _ in range(piece.num_rows)]
            if len(bad):
                chars = char_starts(data)
                base = chars[ends[bad[:, 0]]]
                for r, a, b in zip(bad[:, 0].tolist(), (chars[bad[:, 1]] - base).tolist(), (chars[bad[:, 2]] - base).tolist(), strict=True):
                    spans[r].append({"start": a, "end": b})
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score, pa.float64()), pa.array(spans, _ARROW)], [*names, "score", "toxic_spans"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", SPANS)]))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: ids with crc32 mod 5 = 0 are held out; all are scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = tag(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
