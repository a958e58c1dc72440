"""SimHash fingerprints and exact near-duplicate groups at a bit distance.

Fingerprints are made in Arrow batches. Links are found exactly: distinct
fingerprints are dealt by every choice of two equal blocks out of
``max_distance + 2`` (two fingerprints within the distance agree on at least
two blocks), and inside a deal they are compared in tiles with exclusive-or and
bit counts, tiles being cut in order of population count and a tile pair
skipped when the counts differ beyond the radius. A deal larger than
``DEAL_ROWS`` is cut into parts and every pair of parts becomes its own task
key, so a hot deal spreads over the cluster. A tile group sends on a spanning
forest of its links, never all pairs.

Defined cases: null and empty texts, and texts without a word, have fingerprint
zero and link like any other; fewer words than the shingle length hash as one
shingle; repeated rows and copies share a fingerprint, and so a group; a null
doc_id takes part but is never the smallest id of a group unless all are null;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, pieces, saved, table, text_bytes, word_spans
from .components import components

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
DEAL_ROWS = 512
TILE = 64
PAIRS_AT_ONCE = 128

# byte -> its eight bits in the eight byte lanes of a 64-bit word
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
          .astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)


def _shingle_hashes(data, ends, shingle):
    """XXH64 of every shingle of every row, and the number of shingles per row."""
    rows = len(ends) - 1
    data = LOWER[data]
    is_word = NOT_SPACE[data]
    starts, stops, row = word_spans(is_word, ends)
    n_words = np.bincount(row, minlength=rows)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), n_shingles
    size = stops - starts
    at = np.zeros(len(size) + 1, np.int64)  # where each word starts when one space follows every word
    np.cumsum(size + 1, out=at[1:])
    out = np.full(at[-1], 0x20, np.uint8)
    place = np.ones(at[-1], dtype=bool)
    place[at[1:] - 1] = False
    out[place] = data[is_word]
    first = np.zeros(rows, np.int64)
    np.cumsum(n_words[:-1], out=first[1:])
    of = np.repeat(np.arange(rows), n_shingles)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    a = first[of] + k
    b = a + np.minimum(n_words[of], shingle) - 1
    text, h = out.tobytes(), xxhash.xxh64_intdigest
    return np.array([h(text[s:e], SEED) for s, e in zip(at[a].tolist(), (at[b] + size[b]).tolist(), strict=True)], dtype=np.uint64), n_shingles


def fingerprint_rows(data, ends, shingle=SHINGLE) -> np.ndarray:
    """64-bit fingerprints: bit i is set if it is set in over half the hashes."""
    hashes, n = _shingle_hashes(data, ends, shingle)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some) == 0:
        return out
    # Bits are added in byte lanes over blocks of at most 255 hashes, then blocks are added per row.
    n_blocks = -(-n[some] // 255)
    row_start = np.cumsum(n[some]) - n[some]
    block_of = np.repeat(np.arange(len(some)), n_blocks)
    k = np.arange(len(block_of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    block_start = row_start[block_of] + 255 * k
    row_block = np.cumsum(n_blocks) - n_blocks
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(some), 64), np.int64)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[by_byte[:, j]], block_start)
        counts[:, 8 * j: 8 * j + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), row_block, axis=0)
    bits = (2 * counts > n[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document, the fingerprint as a signed
    64-bit integer, and a hash that tells apart rows that share an id."""
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
                      F.col(text).cast("string").alias("text"))

    def run(batches):
        for piece in pieces(batches, "text"):
            data, ends = text_bytes(piece.column(2))
            fp = pa.array(fingerprint_rows(data, ends, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), fp], ["doc_id", "text_hash", "fp"])

    return own.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _deals(max_distance: int) -> list[str]:
    """SQL keys, one for each choice of two blocks: the choice and the blocks' bits."""
    n = max_distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [f"(shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L)" for a, b in zip(cuts, cuts[1:], strict=False)]
    width = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    if max(width) > 28:
        raise ValueError("blocks of at most 28 bits: max_distance must be 1 or more")
    return [f"(shiftleft({i}L, 56) | shiftleft({block[a]}, {width[b]}) | {block[b]})" for i, (a, b) in enumerate(combinations(range(n), 2))]


def tile_pairs(group: np.ndarray, ones: np.ndarray, radius: int):
    """Pairs of tiles to compare, for rows sorted by (group, population count) and
    cut into tiles of ``TILE``: (first, second, skipped) for each distance between
    tiles. Two tiles can hold a link only if the first ends in the group that the
    second begins with; those whose counts are further apart than the radius
    are skipped."""
    tiles = -(-len(group) // TILE)
    first = np.arange(tiles) * TILE
    last = np.minimum(first + TILE, len(group)) - 1
    yield np.arange(tiles), np.arange(tiles), 0
    a = np.arange(tiles)
    for d in range(1, tiles):
        a = a[a + d < tiles]
        a = a[group[last[a]] == group[first[a + d]]]
        met = len(a)
        a = a[ones[first[a + d]] - ones[last[a]] <= radius]  # counts only rise within a group
        if not met:
            return
        yield a, a + d, met - len(a)


def _forest(group: np.ndarray, part: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups as a spanning forest: (member, root) pairs. In a group
    of two parts only rows of different parts are compared."""
    order = np.lexsort((np.bitwise_count(fp), group))
    group, part, fp = group[order], part[order], fp[order]
    ones = np.bitwise_count(fp).astype(np.int16)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    mixed = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
    two = np.repeat(mixed, np.diff(np.concatenate((starts, [len(fp)]))))
    fill = -len(fp) % TILE
    tiles = [np.concatenate((c, np.full(fill, v, c.dtype))).reshape(-1, TILE) for c, v in ((fp, 0), (group, -1), (part, 0), (two, False))]
    left, right = [], []
    for first, second, _ in tile_pairs(group, ones, radius):
        for k in range(0, len(first), PAIRS_AT_ONCE):
            a, b = first[k: k + PAIRS_AT_ONCE], second[k: k + PAIRS_AT_ONCE]
            f, g, p, t = ((c[a][:, :, None], c[b][:, None, :]) for c in tiles)
            near = (np.bitwise_count(f[0] ^ f[1]) <= radius) & (g[0] == g[1]) & (g[0] >= 0) & (~t[0] | (p[0] != p[1]))
            q, i, j = np.nonzero(near)
            i, j = i + a[q] * TILE, j + b[q] * TILE
            left.append(i[i < j])
            right.append(j[i < j])
    left, right = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(fp))
    while True:  # smallest label over links, then over labels
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            break
        root = new
    m = np.flatnonzero(root != np.arange(len(fp)))
    return fp[m], fp[root[m]]


def _compare(radius: int):
    """Stream over rows sorted by (deal, pair): links of the whole task keys in a batch."""
    def links(key, pair, part, fp):
        group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
        a, b = _forest(group, part, fp, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(held, cols, strict=True)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield links(cols[0][:cut], cols[1][:cut], cols[2][:cut], cols[3][:cut].view(np.uint64))
        if held is not None:
            yield links(held[0], held[1], held[2], held[3].view(np.uint64))

    return run


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of
    all pairs within the distance."""
    keyed = fps.select("fp", F.explode(F.array(*[F.expr(k) for k in _deals(max_distance)])).alias("deal"))
    sizes = saved(keyed.groupBy("deal").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = keyed.join(sizes, "deal").select(
        "deal", "fp", F.ceil(F.col("n") / F.lit(DEAL_ROWS)).cast("int").alias("parts"))
    dealt = dealt.withColumn("part", F.expr("cast(pmod(xxhash64(fp), parts) as int)"))
    dealt = dealt.select("deal", "fp", "part", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    dealt = dealt.select(
        "deal", (F.least("part", "other").cast("bigint") * F.lit(1 << 31) + F.greatest("part", "other")).alias("pair"), "part", "fp")
    return (dealt.repartition("deal", "pair").sortWithinPartitions("deal", "pair")
            .mapInArrow(_compare(max_distance), "a bigint, b bigint").distinct())


def _grouped(docs, text, doc_id, shingle, max_distance):
    """Saved (doc_id, text_hash, fp) rows, and saved (fp, first) rows, where
    first is the group's row of smallest id: (no_id, doc_id, text_hash)."""
    own = saved(fingerprints(docs, text, doc_id, shingle))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    per_fp = saved(own.groupBy("fp").agg(F.min(row).alias("first")))
    label = components(links(per_fp.select("fp"), max_distance))
    labelled = saved(per_fp.join(label.withColumnRenamed("node", "fp"), "fp", "left")
                     .select("fp", "first", F.coalesce("label", "fp").alias("label")))
    smallest = saved(labelled.groupBy("label").agg(F.min("first").alias("first")))
    return own, saved(labelled.select("fp", "label").join(smallest, "label").select("fp", "first"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): one row per document; component_id is the
    smallest doc_id reachable over links, itself included."""
    own, of_fp = _grouped(docs, text, doc_id, shingle, max_distance)
    return own.join(of_fp, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest
    id (of rows that share it, the one of smallest text hash, once)."""
    _, of_fp = _grouped(docs, text, doc_id, shingle, max_distance)

    def key(id_, hash_):  # without nulls, so that the join and the window share one exchange
        return [F.coalesce(id_, F.lit(0).cast("bigint")).alias("_id"), id_.isNull().alias("_no_id"), hash_.alias("_hash")]

    kept = saved(of_fp.select(*key(F.col("first.doc_id"), F.col("first.text_hash"))).distinct())
    rows = docs.select("*", *key(F.col(doc_id).cast("bigint"), F.xxhash64(F.col(text).cast("string"))))
    names = ["_id", "_no_id", "_hash"]
    once = Window.partitionBy(*names).orderBy("_id")
    return (rows.join(kept, names, "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*docs.columns))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
