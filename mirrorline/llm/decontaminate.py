"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside one task (about ``PIECE_BYTES`` of text).
Its words become integers of the benchmark's vocabulary (any other word is a
break); the sequence gets a suffix array, its Burrows-Wheeler transform is held
in a wavelet matrix with bit ranks, and all test phrases are searched backwards
at once. Occurrences are located by walking back to sampled suffix positions,
checked against the phrase, and merged to spans per document.

Runs of vocabulary words shorter than the shortest phrase cannot hold an
occurrence and are left out of the index. Words are looked up by hash; those of
the runs that remain are compared by their bytes before they are indexed.

The benchmark is read in blocks of about ``BLOCK_BYTES`` of text; each block is
a search that adds to the spans found so far. After ``BLOCKS_PER_PASS`` blocks
the documents with their spans are written to the shared folder and the blocks'
broadcasts freed, so memory holds that many blocks, whatever the benchmark's size.

Defined cases: null and empty texts (documents or items) have no words and are
never hit; an item with a null id hits like any other but is not named; copies
and repeated rows get equal results, each on its own; items with equal phrases
are all reported; an item of fewer words than a phrase is one phrase; empty
tables give empty or clean results. Documents may carry any
other columns; the operator adds ``n_words``, ``spans`` and ``items``, dropping
input columns of these names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, SpanHash, char_starts, pieces, stored, table, text_bytes, word_spans

PHRASE = 10
BLOCK_BYTES = 16 << 20
BLOCKS_PER_PASS = 4
SAMPLE = 16

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                  T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))


def _words(data, ends, hasher):
    """Lower-cased text and its words: byte starts, byte ends, row and 64-bit hash."""
    data = LOWER[data]
    starts, stops, row = word_spans(ALNUM[data], ends)
    return data, starts, stops, row, hasher.spans(hasher.prefix(data), starts, stops)


def equal_spans(a, a_starts, a_stops, b, b_starts, b_stops) -> np.ndarray:
    """Whether byte ranges of two texts are equal, pair by pair."""
    size = a_stops - a_starts
    same = size == b_stops - b_starts
    at = np.flatnonzero(same)
    size = size[at]
    if len(at):
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differ = a[np.repeat(a_starts[at], size) + inside] != b[np.repeat(b_starts[at], size) + inside]
        same[at[np.repeat(np.arange(len(at)), size)[differ]]] = False
    return same


class Phrases:
    """Distinct phrases of a block of items over an integer vocabulary (from 1),
    which lists distinct words by their hashes."""

    def __init__(self, items: list[tuple[str | None, str]], length: int, hash_of=SpanHash):
        hasher = hash_of()
        data, ends = text_bytes(pa.array([t or "" for _, t in items], pa.large_string()))
        data, starts, stops, row, hashes = _words(data, ends, hasher)
        raw = data.tobytes()
        spelt = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        first_of = {}
        for k, word in enumerate(spelt):
            first_of.setdefault(word, k)
        order = sorted(first_of.items(), key=lambda e: (int(hashes[e[1]]), e[0]))
        self.hash_of = hash_of
        self.vocabulary = np.array([hashes[k] for _, k in order], np.uint64)
        self.letters = np.frombuffer(b"".join(w for w, _ in order), np.uint8)
        self.ends = np.concatenate(([0], np.cumsum([len(w) for w, _ in order]))).astype(np.int64)
        number = {w: i + 1 for i, (w, _) in enumerate(order)}
        ids = [number[w] for w in spelt]
        found: dict[tuple, set] = {}
        bounds = np.searchsorted(row, np.arange(len(items) + 1)).tolist()
        for k, (item, _) in enumerate(items):
            own = ids[bounds[k]: bounds[k + 1]]
            for p in range(max(1, len(own) - length + 1) if own else 0):
                found.setdefault(tuple(own[p: p + length]), set()).update([] if item is None else [item])
        self.items = [sorted(s) for s in found.values()]
        self.sizes = np.array([len(p) for p in found], np.int64)
        self.words = np.zeros((len(found), length), np.int64)  # right-aligned: the last word is the last column
        for k, p in enumerate(found):
            self.words[k, length - len(p):] = p

    def ids(self, words: np.ndarray) -> np.ndarray:
        """The first vocabulary word of each hash, or 0."""
        if len(self.vocabulary) == 0:
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def proved(self, ids, row, data, starts, stops) -> np.ndarray:
        """``ids`` with those in runs that could hold a phrase compared by bytes: a
        word takes the id of its own spelling, among those of its hash, or none."""
        if len(self.sizes) == 0:
            return ids
        open_ = _kept_runs(ids, row, int(self.sizes.min()))
        ids = ids.copy()
        while len(open_):
            at = ids[open_] - 1
            open_ = open_[~equal_spans(data, starts[open_], stops[open_], self.letters, self.ends[at], self.ends[at + 1])]
            at = ids[open_]  # the next word of the vocabulary
            after = np.minimum(at, len(self.vocabulary) - 1)
            goes_on = (at < len(self.vocabulary)) & (self.vocabulary[after] == self.vocabulary[at - 1])
            ids[open_] = np.where(goes_on, at + 1, 0)
            open_ = open_[goes_on]
        return ids


class WaveletMatrix:
    """Bit planes of a symbol sequence, most significant first; each plane is
    packed in 64-bit words with running counts, and stably sorts by its bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes = []
        at = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((at >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 - len(bit) % 64, np.uint8))), bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.planes.append((level, packed, before, len(bit) - int(bit.sum())))
            at = np.concatenate((at[bit == 0], at[bit == 1]))
        self.bottom = at

    @staticmethod
    def _ones(packed, before, at):
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(packed[block] & low)

    def rank(self, symbols, at):
        """Where the occurrences of each symbol before ``at`` end, in the bottom order."""
        for level, packed, before, zeros in self.planes:
            ones = self._ones(packed, before, at)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def access(self, at):
        """The symbol at each position, and its place in the bottom order."""
        symbol = np.zeros(len(at), np.int64)
        for level, packed, before, zeros in self.planes:
            bit = (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(packed, before, at)
            symbol |= bit.astype(np.int64) << level
            at = np.where(bit.astype(bool), zeros + ones, at - ones)
        return symbol, at


class FMIndex:
    """Index of a sequence of symbols from 1, where 0 breaks the sequence (the
    first and last symbol are breaks). Breaks differ from each other, so
    suffixes are compared up to the next break only."""

    def __init__(self, symbols: np.ndarray, bits: int):
        n = len(symbols)
        breaks = np.flatnonzero(symbols == 0)
        rank = symbols + len(breaks) - 1
        rank[breaks] = np.arange(len(breaks))
        step = 1
        while True:  # prefix doubling: rank by the first 2 * step symbols
            second = np.zeros(n, np.int64)
            second[:-step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + second
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
            rank = new
            if rank.max() == n - 1 or step * 2 >= n:
                break
            step *= 2
        suffixes = np.argsort(rank)
        bwt = symbols[suffixes - 1]
        self.n = n
        self.matrix = WaveletMatrix(bwt, bits)
        counts = np.bincount(symbols, minlength=1 << bits)
        self.first = np.cumsum(counts) - counts  # in suffix order: symbols ascend, breaks first
        bottom_counts = np.bincount(self.matrix.bottom, minlength=1 << bits)
        # where each symbol starts in the bottom order (which is by reversed bits)
        seen = np.flatnonzero(np.concatenate(([True], self.matrix.bottom[1:] != self.matrix.bottom[:-1])))
        self.base = np.zeros(1 << bits, np.int64)
        self.base[self.matrix.bottom[seen]] = seen
        self.present = bottom_counts > 0
        # Sampled suffixes: every SAMPLE-th position, and each that follows a break, so that no walk crosses one.
        sampled = (suffixes % SAMPLE == 0) | (bwt == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = suffixes[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of right-aligned phrases (0 pads on the left), backwards."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            live = np.flatnonzero((symbol > 0) & (low < high))
            if len(live) == 0:
                continue
            s = symbol[live]
            shift = self.first[s] - self.base[s]
            lo = self.matrix.rank(s, low[live]) + shift
            hi = self.matrix.rank(s, high[live]) + shift
            gone = ~self.present[s]
            low[live] = np.where(gone, 0, lo)
            high[live] = np.where(gone, 0, hi)
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk back to a sampled suffix."""
        out = np.empty(len(at), np.int64)
        open_, steps = np.arange(len(at)), 0
        at = at.copy()
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.samples[self.sample_rank[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            symbol, place = self.matrix.access(at)
            at = self.first[symbol] + place - self.base[symbol]
            steps += 1
        return out


def _kept_runs(ids: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """Words in runs (inside one row) of at least ``least`` vocabulary words."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (ids[1:] == 0) | (ids[:-1] == 0)))
    run = np.cumsum(new) - 1
    return np.flatnonzero((ids > 0) & (np.bincount(run)[run] >= least))


def occurrences(ids: np.ndarray, row: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word position) of every occurrence in a shard's words."""
    none = np.zeros(0, np.int64)
    if len(phrases.sizes) == 0:
        return none, none
    kept = _kept_runs(ids, row, int(phrases.sizes.min()))
    if len(kept) == 0:
        return none, none
    apart = np.concatenate(([True], (np.diff(kept) > 1) | (row[kept[1:]] != row[kept[:-1]])))
    at = np.arange(len(kept)) + np.cumsum(apart)  # a break before each run
    symbols = np.zeros(at[-1] + 2, np.int64)
    symbols[at] = ids[kept]
    word_of = np.zeros(len(symbols), np.int64)
    word_of[at] = kept
    index = FMIndex(symbols, int(len(phrases.vocabulary)).bit_length())
    low, high = index.search(phrases.words)
    found = np.flatnonzero(high > low)
    size = (high - low)[found]
    of = np.repeat(found, size)
    ranks = np.repeat(low[found], size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    place = index.locate(ranks)
    right = np.ones(len(of), dtype=bool)  # each occurrence against its phrase
    length = phrases.words.shape[1]
    for j in range(length):
        behind = length - 1 - j
        use = phrases.sizes[of] > behind
        end = np.clip(place + phrases.sizes[of] - 1 - behind, 0, len(symbols) - 1)  # shorter phrases are masked
        right &= ~use | (symbols[end] == phrases.words[of, j])
    if not right.all():
        raise AssertionError("an index position does not hold its phrase")
    return of, word_of[place]


def _pass(phrases_of, columns: list[str], text: str, chained: bool):
    def run(batches):
        phrases = phrases_of.value
        hasher = phrases.hash_of()
        for piece in pieces(batches, text):
            data, ends = text_bytes(piece.column(piece.schema.get_field_index(text)))
            data, starts, stops, row, words = _words(data, ends, hasher)
            rows = piece.num_rows
            n_words = np.bincount(row, minlength=rows)
            of, at = occurrences(phrases.proved(phrases.ids(words), row, data, starts, stops), row, phrases)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + phrases.sizes[of], -1)
            spans = piece.column(piece.schema.get_field_index("spans")).to_pylist() if chained else [[] for _ in range(rows)]
            items = piece.column(piece.schema.get_field_index("items")).to_pylist() if chained else [[] for _ in range(rows)]
            before = {r: (spans[r], set(items[r])) for r in range(rows) if spans[r]}
            if len(at):
                first = np.searchsorted(row, np.arange(rows + 1))
                for r in before:
                    for s in before[r][0]:
                        cover[first[r] + s["first_word"]] += 1
                        cover[first[r] + s["last_word"] + 1] -= 1
                hit_rows = np.unique(row[at])
                hit = np.cumsum(cover)[:-1] > 0
                chars = char_starts(data)
                edge = hit & np.concatenate(([True], ~hit[:-1] | (row[1:] != row[:-1])))
                last = hit & np.concatenate((~hit[1:] | (row[1:] != row[:-1]), [True]))
                a, b = np.flatnonzero(edge), np.flatnonzero(last)
                named: dict[int, set] = {}
                for r, p in np.unique(np.stack((row[at], of), axis=1), axis=0).tolist():
                    named.setdefault(r, set()).update(phrases.items[p])
                span_row = row[a]
                for r in hit_rows.tolist():
                    k = slice(*np.searchsorted(span_row, [r, r + 1]))
                    base = chars[ends[r]]
                    spans[r] = [{"start": int(chars[starts[x]] - base), "end": int(chars[stops[y]] - base),
                                 "first_word": int(x - first[r]), "last_word": int(y - first[r])}
                                for x, y in zip(a[k], b[k], strict=True)]
                    items[r] = sorted(before.get(r, ([], set()))[1] | named[r])
            arrays = [piece.column(piece.schema.get_field_index(c)) for c in columns]
            arrays += [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_words", "spans", "items"])

    return run


_SPANS_ARROW = pa.list_(pa.struct([(f.name, pa.int64()) for f in SPANS.elementType.fields]))


def _blocks(benchmark: DataFrame, item: str, text: str):
    """The benchmark's items in blocks of bounded text, read one partition at a time."""
    own = benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).where(F.col(text).isNotNull())
    block, size = [], 0
    for row in own.toLocalIterator():
        block.append((row[0], row[1]))
        size += 4 * len(row[1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", phrase: int = PHRASE) -> DataFrame:
    """``docs`` with n_words (long), spans (array of character start, end and of
    first and last word position, merged and in order) and items (sorted ids)."""
    sc = docs.sparkSession.sparkContext
    own = docs.drop("n_words", "spans", "items")
    out = own.withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*out.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    held = []
    for k, block in enumerate(_blocks(benchmark, item, item_text)):
        if len(held) == BLOCKS_PER_PASS:
            out = stored(out)
            for one in held:
                one.unpersist()
            held = []
        held.append(sc.broadcast(Phrases(block, phrase)))
        out = out.mapInArrow(_pass(held[-1], own.columns, text, k > 0), schema)
    return out


def cut_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The text without its spans. A null text stays null; texts without a span
    are untouched."""
    pieces_ = (f"concat(array_join(transform(spans, (s, i) -> substring(`{text}`, if(i = 0, 0, get(spans, i - 1).end) + 1,"
               f" s.start - if(i = 0, 0, get(spans, i - 1).end))), ''), substring(`{text}`, element_at(spans, -1).end + 1))")
    return found.withColumn(text, F.when(F.size("spans") > 0, F.expr(pieces_)).otherwise(F.col(text)))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: all of ``documents`` against all of ``benchmark``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_passages(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last_word"] - x["first_word"] + 1)
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select distinct item_id, case when len(ws) < 10 then ws else ws[p:p + 9] end as w
        from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as p from bw where len(ws) > 0)),
sizes as (select distinct len(w) as n from win),
occ as (select doc_id, p, n, ws[p:p + n - 1] as w from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from dw, sizes where len(ws) >= n)),
hits as (select doc_id, p, n, item_id from occ join win using (w)),
words as (select doc_id, count(*) as n_hit from (select distinct doc_id, q from (select doc_id, unnest(range(p, p + n)) as q from hits)) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids
          from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
select dw.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words on dw.doc_id = words.doc_id left join named on dw.doc_id = named.doc_id
"""
