"""Exact removal of repeated byte strings, by sorting suffixes around anchors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else. Each such window belongs to one anchor, its least ``GRAM``-byte gram by
hash (leftmost of equals), so equal windows have equal anchors at equal offsets,
and neighbouring windows of one anchor form a stretch. Stretches are what moves:

1. Every document sends (anchor, stretch hash) rows; anchors seen twice or more
   are kept. If all stretches of an anchor are equal, all their windows repeat.
2. For the other (mixed) anchors the distinct stretches themselves are sent, and
   their suffixes from the anchor are sorted per anchor: multikey quicksort on
   8-byte characters to a shallow depth, then a blind trie for every group that
   still agrees. Common prefixes of neighbours and the bytes left of the anchor
   tell which windows occur twice.
3. The windows found go back to their documents and are cut out.

Anchors of more than ``HOT`` distinct stretches (a common line in very many
different texts) are not sorted in one task: their windows are counted by hash,
pre-aggregated, which gives the same windows.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` bytes keep
everything; exact copies and repeated rows remove each other wholly; rows with
null ids are handled like others; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, mixed, pieces, saved, stored, table, text_bytes, whole_groups

LENGTH = 200
GRAM = 40
HOT = 20_000  # stretches of one anchor that a task sorts (some 6 MB)
SHALLOW = 64
CHUNK = 1 << 21
_PLACE = np.uint64((1 << 31) - 1)


class Anchors:
    """Stretches of the windows of some texts: row, first and last window start,
    anchor position, anchor hash and stretch hash."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, hasher: SpanHash, length: int):
        gram = min(GRAM, length)
        parts = []
        for at in range(0, max(len(data) - length + 1, 0), CHUNK):
            part = data[at: at + CHUNK + length - 1]
            n = len(part)
            first, last = np.maximum(ends[:-1], at), np.minimum(ends[1:], at + n)
            rows = np.flatnonzero(last - first >= length)
            if len(rows) == 0:
                continue
            first, last = first[rows] - at, last[rows] - at - length  # window starts of each row
            sums = hasher.prefix(part)
            grams = n - gram + 1
            hashes = hasher.spans(sums, np.arange(grams), np.arange(gram, n + 1))
            value = (hashes & ~_PLACE) | np.arange(grams, dtype=np.uint64)
            least = _sliding_least(value, length - gram + 1)
            size = last - first + 1
            window = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            row = np.repeat(rows, size)
            anchor = (least[window] & _PLACE).astype(np.int64)
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
            a = np.flatnonzero(new)
            b = np.concatenate((a[1:], [len(new)])) - 1
            p0, p1, spot = window[a], window[b], anchor[a]
            whole = mixed(hasher.spans(sums, p0, p1 + length) ^ mixed((spot - p0).astype(np.uint64) + np.uint64(1)))
            parts.append((row[a], p0 + at, p1 + at, spot + at, hashes[spot], whole))
        if parts:
            self.row, self.p0, self.p1, self.spot, self.hash, self.whole = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            z = np.zeros(0, np.int64)
            self.row = self.p0 = self.p1 = self.spot = z
            self.hash = self.whole = z.astype(np.uint64)


def _sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima inside blocks."""
    n = len(value)
    block = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = value
    block = block.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1: width - 1 + m])


class BlindTrie:
    """Sorts byte strings that agree for long: branches hold only the depth at
    which strings part, and a string is compared with one leaf when inserted."""

    def __init__(self):
        self.root = None

    def insert(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = (text, [item])
            return
        node = self.root
        while len(node) == 3:  # blindly to some leaf
            node = node[1].get(_at(text, node[0])) or next(iter(node[1].values()))
        depth = common(text, node[0])
        if depth == len(text) == len(node[0]):
            node[1].append(item)
            return
        parent, node = None, self.root
        while len(node) == 3 and node[0] < depth:
            parent, node = node, node[1][_at(text, node[0])]
        if len(node) == 3 and node[0] == depth:
            node[1][_at(text, depth)] = (text, [item])
            return
        some = node
        while len(some) == 3:
            some = next(iter(some[1].values()))
        branch = (depth, {_at(some[0], depth): node, _at(text, depth): (text, [item])}, None)
        if parent is None:
            self.root = branch
        else:
            parent[1][_at(text, parent[0])] = branch

    def items(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def _at(text: bytes, depth: int) -> int:
    return text[depth] if depth < len(text) else -1


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def deep_shallow(texts: list[bytes], group: np.ndarray) -> np.ndarray:
    """Order of byte strings inside their groups (``group`` ascending): multikey
    quicksort to ``SHALLOW`` bytes, all groups in step, then blind tries."""
    n = len(texts)
    head = np.frombuffer(b"".join(t[:SHALLOW].ljust(SHALLOW, b"\0") for t in texts), ">u8").reshape(n, SHALLOW // 8).astype(np.uint64)
    order, part = np.arange(n), group.astype(np.int64)
    for character in range(SHALLOW // 8):
        single = np.ones(n, bool)
        single[1:] &= part[1:] != part[:-1]
        single[:-1] &= part[1:] != part[:-1]
        open_ = np.flatnonzero(~single)
        if len(open_) == 0:
            break
        key = head[order[open_], character]
        by = np.lexsort((key, part[open_]))
        order[open_] = order[open_][by]
        key = key[by]
        split = np.zeros(n, bool)
        own = part[open_]
        split[open_[1:]] = (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        new = np.concatenate(([True], part[1:] != part[:-1])) | split
        part = np.cumsum(new) - 1
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a > 1:
            trie = BlindTrie()
            for i in order[a:b].tolist():
                trie.insert(texts[i], i)
            order[a:b] = trie.items()
    return order


def repeated_windows(group: np.ndarray, strings: list[bytes], lead: np.ndarray, times: np.ndarray, length: int) -> list[list[int]]:
    """Per stretch (rows by ascending group): runs [first, last, ...] of window
    starts inside it that occur twice. ``lead``: bytes before the anchor."""
    n = len(strings)
    right = [s[o:] for s, o in zip(strings, lead.tolist(), strict=True)]
    order = deep_shallow(right, group)
    group, lead, times = group[order], lead[order], times[order]
    strings, right = [strings[i] for i in order], [right[i] for i in order]
    size = np.array([len(s) for s in strings])
    same = np.zeros(n, np.int64)  # bytes shared with the string before, in order
    for i in range(1, n):
        same[i] = common(right[i - 1], right[i]) if group[i] == group[i - 1] else -1
    least, most = lead - (size - length), lead
    flat = np.frombuffer(b"".join(strings), np.uint8)
    at = np.cumsum(size) - size
    found = np.zeros((n, int(most.max()) + 2), bool)  # by window start inside the stretch
    left = group.astype(np.int64)
    for o in range(int(most.max()) + 1):
        live = np.flatnonzero((least <= o) & (o <= most))
        if len(live):
            new = same < length - o
            new[0] = True
            klass = left[live] * n + np.cumsum(new)[live]
            _, back = np.unique(klass, return_inverse=True)
            twice = np.bincount(back, weights=times[live])[back] >= 2
            hit = live[twice]
            found[hit, lead[hit] - o] = True
        longer = np.flatnonzero(most > o)
        if len(longer):  # one more byte on the left
            byte = flat[at[longer] + lead[longer] - o - 1]
            _, refined = np.unique(left[longer] * 256 + byte, return_inverse=True)
            left[longer] = refined
    edges = np.diff(np.concatenate((np.zeros((n, 1), np.int8), found.astype(np.int8)), axis=1), axis=1)
    out: list[list[int]] = [[] for _ in range(n)]
    i, a = np.nonzero(edges == 1)
    _, b = np.nonzero(edges == -1)
    for k, x, y in zip(order[i].tolist(), a.tolist(), (b - 1).tolist(), strict=True):
        out[k] += [x, y]
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _text_pieces(batches):
    hasher = SpanHash()
    for piece in pieces(batches, "text", CHUNK):
        data, ends = text_bytes(piece.column(piece.schema.get_field_index("text")))
        yield piece, data, ends, hasher


def _send_anchors(length):
    def run(batches):
        for piece, data, ends, hasher in _text_pieces(batches):
            x = Anchors(data, ends, hasher, length)
            key = piece.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([_signed(x.hash), _signed(x.whole), pa.array(key[x.row])], ["anchor", "whole", "key"])

    return run


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a list column; a null list has none."""
    size = np.diff(column.offsets.to_numpy()) if column.null_count == 0 else np.array([0 if v is None else len(v) for v in column.to_pylist()])
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy(zero_copy_only=False)


def _row_key(row, value):
    return mixed(value.astype(np.int64).view(np.uint64) ^ mixed(row.astype(np.uint64) + np.uint64(1)))


def _send_stretches(length):
    def run(batches):
        for piece, data, ends, hasher in _text_pieces(batches):
            x = Anchors(data, ends, hasher, length)
            row, mixed_anchor = _pairs(piece.column(piece.schema.get_field_index("mixed")))
            at = np.flatnonzero(np.isin(_row_key(x.row, x.hash.view(np.int64)), _row_key(row, mixed_anchor)))
            whole = data.tobytes()
            strings = [whole[a: b + length] for a, b in zip(x.p0[at].tolist(), x.p1[at].tolist(), strict=True)]
            key = piece.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [_signed(x.hash[at]), _signed(x.whole[at]), pa.array(key[x.row[at]]), pa.array((x.spot - x.p0)[at].astype(np.int32)), pa.array(strings, pa.binary())],
                ["anchor", "whole", "key", "lead", "bytes"])

    return run


def _sort_stretches(length):
    def run(batches):
        for part in whole_groups(batches, ["anchor"], 8192):
            anchor = part.column("anchor").to_numpy()
            group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
            runs = repeated_windows(group, part.column("bytes").to_pylist(), part.column("lead").to_numpy().astype(np.int64),
                                    part.column("times").to_numpy(), length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), part.column("whole").combine_chunks(), pa.array(runs, pa.list_(pa.int32()))], ["anchor", "whole", "runs"])

    return run


def _send_windows(length):
    """Every window of hot anchors' stretches, as hashes."""
    def run(batches):
        for batch in batches:
            strings = batch.column(batch.schema.get_field_index("bytes")).to_pylist()
            lead = batch.column(batch.schema.get_field_index("lead")).to_numpy()
            for a in range(0, len(strings), 2048):
                own = strings[a: a + 2048]
                size = np.array([len(s) for s in own])
                first = np.cumsum(size) - size
                data = np.frombuffer(b"".join(own), np.uint8)
                hasher = SpanHash()
                count = size - length + 1
                of = np.repeat(np.arange(len(own)), count)
                j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                sums = hasher.prefix(data)
                window = hasher.spans(sums, first[of] + j, first[of] + j + length)
                take = pa.array(a + of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("anchor")).take(take), batch.column(batch.schema.get_field_index("whole")).take(take),
                     batch.column(batch.schema.get_field_index("times")).take(take), pa.array((lead[a + of] - j).astype(np.int32)),
                     pa.array(j.astype(np.int32)), _signed(window)], ["anchor", "whole", "times", "lead", "start", "window"])

    return run


def _cut(length, with_text):
    def run(batches):
        for piece, data, ends, hasher in _text_pieces(batches):
            rows = piece.num_rows
            x = Anchors(data, ends, hasher, length) if piece.column(piece.schema.get_field_index("equal")).null_count < rows else Anchors(data[:0], ends[:1], hasher, length)
            row, equal = _pairs(piece.column(piece.schema.get_field_index("equal")))
            at = np.flatnonzero(np.isin(_row_key(x.row, x.hash.view(np.int64)), _row_key(row, equal)))
            first, last = [x.p0[at]], [x.p1[at] + length]
            found = piece.column(piece.schema.get_field_index("some"))
            row, _ = _pairs(found)
            some = found.flatten()
            if len(some):
                by = {(r, h, w): runs for r, h, w, runs in zip(row.tolist(), some.field("anchor").to_pylist(), some.field("whole").to_pylist(), some.field("runs").to_pylist(), strict=True)}
                mine = np.flatnonzero(np.isin(_row_key(x.row, x.hash.view(np.int64)), _row_key(row, some.field("anchor").to_numpy())))
                a, b = [], []
                for r, h, w, p in zip(x.row[mine].tolist(), x.hash.view(np.int64)[mine].tolist(), x.whole.view(np.int64)[mine].tolist(), x.p0[mine].tolist(), strict=True):
                    runs = by.get((r, h, w), ())
                    a += [p + s for s in runs[::2]]
                    b += [p + e + length for e in runs[1::2]]
                first.append(np.array(a, np.int64))
                last.append(np.array(b, np.int64))
            cover = np.zeros(len(data) + 1, np.int32)
            np.add.at(cover, np.concatenate(first), 1)
            np.add.at(cover, np.concatenate(last), -1)
            gone = np.cumsum(cover)[:-1] > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[ends[1:]] - total[ends[:-1]]
            begins = gone & np.concatenate(([True], ~gone[:-1]))[: len(gone)]
            begins[ends[:-1][ends[:-1] < len(gone)]] |= gone[ends[:-1][ends[:-1] < len(gone)]]
            spans = np.concatenate(([0], np.cumsum(begins)))
            spans = spans[ends[1:]] - spans[ends[:-1]]
            kept = [data[a:b].tobytes() if not removed[k] else data[a:b][~gone[a:b]].tobytes() for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
            arrays = [piece.column(piece.schema.get_field_index("doc_id")), pa.array(np.diff(ends), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                      pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    and (with_text) the bytes kept."""
    own = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # A key only finds the anchors to look up; equal keys of different texts do no harm.
    texts = own.select("key", "text")
    anchors = texts.mapInArrow(_send_anchors(length), "anchor bigint, whole bigint, key bigint")
    twice = saved(anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
                  .where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("is_mixed")))
    lists = stored(anchors.select("anchor", "key").join(twice, "anchor").groupBy("key").agg(
        F.collect_set(F.when(~F.col("is_mixed"), F.col("anchor"))).alias("equal"),
        F.collect_set(F.when(F.col("is_mixed"), F.col("anchor"))).alias("mixed")))
    stretches = stored(texts.join(lists.where(F.size("mixed") > 0).select("key", "mixed"), "key")
                       .mapInArrow(_send_stretches(length), "anchor bigint, whole bigint, key bigint, lead int, bytes binary"))
    distinct = stored(stretches.groupBy("anchor", "whole").agg(F.count("*").alias("times"), F.min("lead").alias("lead"), F.min("bytes").alias("bytes")))
    hot = saved(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"))
    columns = "anchor bigint, whole bigint, runs array<int>"
    sorted_ = (distinct.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
               .mapInArrow(_sort_stretches(length), columns))
    windows = stored(distinct.join(hot, "anchor", "left_semi")
                     .mapInArrow(_send_windows(length), "anchor bigint, whole bigint, times bigint, lead int, start int, window bigint"))
    again = saved(windows.groupBy("anchor", "lead", "window").agg(F.sum("times").alias("n")).where("n > 1").drop("n"))
    counted = (windows.join(again, ["anchor", "lead", "window"]).groupBy("anchor", "whole")
               .agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("runs")))
    verdicts = saved(sorted_.unionByName(counted).where(F.size("runs") > 0))
    some = (stretches.select("anchor", "whole", "key").distinct().join(verdicts, ["anchor", "whole"])
            .groupBy("key").agg(F.collect_list(F.struct("anchor", "whole", "runs")).alias("some")))
    found = lists.select("key", "equal").join(some, "key", "left").select("key", "equal", F.coalesce("some", F.expr(
        "cast(array() as array<struct<anchor:bigint,whole:bigint,runs:array<int>>>)")).alias("some"))
    out = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return own.join(found, "key", "left").mapInArrow(_cut(length, with_text), out + (", kept binary" if with_text else ""))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
