"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is escaped as the tokenizer does it (spaces become U+2581, one in
front) and cut before every run of that mark, which no piece crosses; the
distinct segments of the batch are joined to one sequence. Its suffix array (to
the length of the longest piece) is built, every piece is binary-searched for
its range of occurrences, and the ranges become edges of a lattice. Edges are
sorted by end position and relaxed.

The vocabulary is of the byte-pair kind, so an edge relaxes a position if its
piece may stand after the last piece of the best path to where it starts, that
is if merging the two pieces' characters gives these two pieces again. Each
prefix has one such path, and it is the tokenizer's own result: merges inside a
run of pieces happen in the same order whether or not text follows. Characters
outside the vocabulary are edges of their own that become byte pieces. Segments are
relaxed side by side, position by position; those of more than ``LONG`` characters
(scripts without spaces) each by themselves, edge by edge in the same order.

Defined cases: a null or empty text has no pieces and decodes to an empty text;
a text that holds U+2581 itself decodes with a space in its place, as the
tokenizer's own decoding does; copies and repeated rows encode alike; an empty
table gives an empty result; other columns pass through, and input columns
named like the results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import mixed, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 4 << 20
SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
CACHE = 1 << 21
LONG = 512  # characters from which a segment is relaxed by itself
EDGES_AT_ONCE = 1 << 16


def _bpe(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merging of a short string: pieces, and the last merge."""
    parts, last = list(text), None
    while True:
        best = min(((rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank), default=None)
        if best is None:
            return parts, last
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i: i + 2] = [parts[i] + parts[i + 1]]


class Vocabulary:
    """Pieces of a model file, their merge order and which pairs may be neighbours."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        self.unknown = n  # the id of an edge for a character outside the vocabulary
        self.byte_id = np.zeros(256, np.int32)
        names = [model.id_to_piece(i) for i in range(n)]
        plain = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(name[1:-1], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                plain.append(i)
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        order = {s: k + 1 for k, s in enumerate(scores)}
        by_name = {names[i]: i for i in plain}
        rank_of = {names[i]: order[model.get_score(i)] for i in plain}
        self.rank = np.zeros(n + 1, np.int64)  # 0: a single character, never merged
        self.left = np.arange(n + 1)
        self.right = np.arange(n + 1)
        pairs: dict[int, int] = {}
        usable = []
        for i in plain:
            name = names[i]
            if len(name) > 1:
                parts, last = _bpe(name, rank_of)
                for k in range(1, len(name)):
                    a, b = by_name.get(name[:k]), by_name.get(name[k:])
                    if a is not None and b is not None:
                        pairs[a * (n + 1) + b] = rank_of[name]
                if len(parts) > 1 or last[0] not in by_name or last[1] not in by_name:
                    continue  # merging never makes this piece
                self.rank[i] = rank_of[name]
                self.left[i], self.right[i] = by_name[last[0]], by_name[last[1]]
            usable.append(i)
        self.merge_keys = np.array(sorted(pairs), np.int64)
        self.merge_rank = np.array([pairs[k] for k in self.merge_keys.tolist()], np.int64)
        # Equal scores are only ordered by position; pairs of such pieces are tried out.
        ties = [i for i in usable if len(names[i]) > 1 and (rank_of[names[i]] == self.rank[self.left[i]] or rank_of[names[i]] == self.rank[self.right[i]])]
        runs = sorted({*ties, *(int(self.left[i]) for i in ties), *(int(self.right[i]) for i in ties)})
        self.tried = np.array(sorted(a * (n + 1) + b for a in runs for b in runs), np.int64)
        self.tried_ok = np.array([_bpe(names[k // (n + 1)] + names[k % (n + 1)], rank_of)[0] == [names[k // (n + 1)], names[k % (n + 1)]] for k in self.tried.tolist()], bool)
        self.ids = np.array(usable, np.int64)
        self.lengths = np.array([len(names[i]) for i in usable], np.int64)
        self.longest = int(self.lengths.max())
        self.alphabet = np.unique(np.frombuffer("".join(names[i] for i in usable).encode("utf-32-le"), np.uint32))
        if len(self.alphabet) >= 0xFFFE:
            raise ValueError("an alphabet of at most 65,533 characters")
        codes = np.full((len(usable), self.longest), 0, ">u2")
        for row, i in enumerate(usable):
            codes[row, : len(names[i])] = self.codes(np.frombuffer(names[i].encode("utf-32-le"), np.uint32))
        self.low_key = codes.copy()
        filled = np.arange(self.longest)[None, :] >= self.lengths[:, None]
        codes[filled] = 0xFFFF
        self.high_key = codes
        # bytes of each piece for decoding, the mark as a space
        shown = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for i in range(n):
            if model.is_byte(i):
                shown[i] = bytes([int(names[i][1:-1], 16)])
            elif model.is_control(i):
                shown[i] = b""
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def codes(self, characters: np.ndarray) -> np.ndarray:
        """1.. for the alphabet; one more for any other character."""
        at = np.minimum(np.searchsorted(self.alphabet, characters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == characters, at + 1, len(self.alphabet) + 1)

    def _merged(self, a, b):
        """Rank of the piece that a and b merge to; a huge one if to none."""
        key = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_rank[at], 1 << 40)

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b gives a and b again.

        Undo merges backwards in time at the boundary: of the two pieces that
        meet there the one made later is split. If the two that then meet would
        have merged before that split piece was made, a and b never form."""
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a < self.size) & (b < self.size))
        x, y = a[at], b[at]
        limit = np.full(len(at), 1 << 39)
        while len(at):
            clash = self._merged(x, y) < limit
            ok[at[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & ((rx > 0) | (ry > 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            later = rx > ry  # of equal ranks the left one merges first, so the right one is later
            limit = np.where(later, rx, ry + 1)
            x = np.where(later, self.right[x], x)
            y = np.where(later, y, self.left[y])
        key = a * (self.size + 1) + b
        if len(self.tried):
            k = np.minimum(np.searchsorted(self.tried, key), len(self.tried) - 1)
            ok = np.where(self.tried[k] == key, self.tried_ok[k], ok)
        return ok


class Encoder:
    """Encodes batches of texts; remembers which pairs of pieces may be neighbours."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.keys = np.full(CACHE, -1, np.int64)
        self.oks = np.zeros(CACHE, bool)

    def _may_follow(self, a, b):
        key = a.astype(np.int64) * (self.v.size + 1) + b
        slot = (mixed(key.astype(np.uint64)) & np.uint64(CACHE - 1)).astype(np.int64)
        ok = self.oks[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            answer = self.v.neighbours(new // (self.v.size + 1), new % (self.v.size + 1))
            ok[miss] = answer[back]
            home = (mixed(new.astype(np.uint64)) & np.uint64(CACHE - 1)).astype(np.int64)
            self.keys[home], self.oks[home] = new, False
            won = self.keys[home] == new  # two new keys may share a slot
            self.oks[home[won]] = answer[won]
        return ok

    def _edges(self, codes: np.ndarray):
        """(start, length, piece) of every occurrence of a piece: suffix array to
        the longest piece's depth, a binary search per piece, ranges read off."""
        n, depth = len(codes), self.v.longest
        padded = np.zeros(n + depth + 4, np.uint64)
        padded[:n] = codes
        key = np.zeros(n, np.uint64)
        for k in range(4):
            key = (key << np.uint64(16)) | padded[k: n + k]
        covered = 4
        while True:
            order = np.argsort(key).astype(np.int32)
            ordered = key[order]
            if covered >= depth:
                break
            rank = np.empty(n + covered, np.uint64)
            rank[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])), dtype=np.uint64)
            rank[n:] = 0
            key = (rank[:n] << np.uint64(32)) | rank[covered:]
            covered *= 2
        del key, ordered
        text = padded[: n + depth].astype(">u2")
        window = np.lib.stride_tricks.sliding_window_view(text, depth)[order]
        kind = f"S{2 * depth}"
        suffixes = np.ascontiguousarray(window).view(kind).ravel()
        del window
        low = np.searchsorted(suffixes, self.v.low_key.view(kind).ravel(), side="left")
        high = np.searchsorted(suffixes, self.v.high_key.view(kind).ravel(), side="right")
        del suffixes
        size = high - low
        some = np.flatnonzero(size > 0)
        size = size[some]
        start = gathered(order, low[some], size)
        length = np.repeat(self.v.lengths[some].astype(np.int32), size)
        piece = np.repeat(self.v.ids[some].astype(np.int32), size)
        stray = np.flatnonzero(codes == len(self.v.alphabet) + 1).astype(np.int32)
        return (np.concatenate((start, stray)), np.concatenate((length, np.ones(len(stray), np.int32))),
                np.concatenate((piece, np.full(len(stray), self.v.unknown, np.int32))))

    def _relax_long(self, start, end, piece, firsts, last, back, steps):
        """Relaxation of a few long segments: their edges one after the other by end
        position. Whether each may follow the edges that end where it starts is
        found beforehand, for many at once."""
        order = np.argsort(end, kind="stable")
        start, end, piece = start[order].astype(np.int64), end[order], piece[order]
        low = np.searchsorted(end, start, "left")
        before = np.searchsorted(end, start, "right") - low
        chosen = np.full(len(last), -1, np.int64)  # the edge that reached a position
        chosen[firsts] = -2
        chosen_of, last_of, back_of, steps_of = map(memoryview, (chosen, last, back, steps))
        for a in range(0, len(start), EDGES_AT_ONCE):
            b = min(a + EDGES_AT_ONCE, len(start))
            first_pair = np.cumsum(before[a:b]) - before[a:b]
            earlier = np.repeat(low[a:b] - first_pair, before[a:b]) + np.arange(int(before[a:b].sum()))
            may = self._may_follow(piece[earlier], np.repeat(piece[a:b], before[a:b])).tolist()
            shift = (first_pair - low[a:b]).tolist()
            for j, s, e, p, shifted in zip(range(a, b), start[a:b].tolist(), end[a:b].tolist(), piece[a:b].tolist(), shift, strict=True):
                edge = chosen_of[s]
                if edge == -2 or edge >= 0 and may[shifted + edge]:
                    chosen_of[e] = j
                    last_of[e], back_of[e], steps_of[e] = p, s, steps_of[s] + 1

    def _segments(self, segments: list[str]):
        """Ids of each segment: flat ids and offsets."""
        characters = np.frombuffer(("\0" + "\0".join(segments) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(s) for s in segments], np.int64)
        first = np.cumsum(size + 1) - size  # behind the break in front of each
        n = len(characters)
        codes = self.v.codes(characters)
        codes[np.concatenate((first - 1, [n - 1]))] = 0
        start, length, piece = self._edges(codes)
        origin = np.repeat(np.concatenate((first, [n])), np.concatenate((size + 1, [1])))[: n]
        origin = np.concatenate(([0], origin))[:n].astype(np.int32)
        end = start + length
        last = np.full(n + 1, -1, np.int32)
        back = np.zeros(n + 1, np.int32)
        steps = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(size > LONG)
        if len(long):
            inside = np.zeros(n + 1, bool)
            for k in long.tolist():
                inside[first[k]: first[k] + size[k]] = True
            of_long = inside[start]
            self._relax_long(start[of_long], end[of_long], piece[of_long], first[long], last, back, steps)
            start, end, piece, length = (c[~of_long] for c in (start, end, piece, length))
        reach = end - origin[start]
        order = np.argsort(reach.astype(np.int32), kind="stable")
        start, end, piece, reach = start[order], end[order], piece[order], reach[order]
        del order, length
        cut = np.flatnonzero(np.concatenate(([True], reach[1:] != reach[:-1], [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # edges by end position
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = last[s]
            ok = before < 0
            inner = np.flatnonzero(~ok)
            ok[inner] = self._may_follow(before[inner], p[inner])
            s, e, p = s[ok], e[ok], p[ok]
            last[e], back[e], steps[e] = p, s, steps[s] + 1
        stop = first + size
        count = steps[stop].astype(np.int64)
        offsets = np.zeros(len(segments) + 1, np.int64)
        np.cumsum(count, out=offsets[1:])
        out = np.empty(offsets[-1], np.int64)
        where = np.empty(offsets[-1], np.int64)
        at, put = stop.copy(), offsets[1:] - 1
        last_of, back_of = memoryview(last), memoryview(back)
        for k in long.tolist():
            x, to, begin = int(stop[k]), int(put[k]), int(first[k])
            out_of, where_of = memoryview(out), memoryview(where)
            while x > begin:
                out_of[to], where_of[to] = last_of[x], back_of[x]
                x, to = back_of[x], to - 1
        live = np.flatnonzero(size <= LONG)
        while len(live):
            out[put[live]] = last[at[live]]
            where[put[live]] = back[at[live]]
            at[live] = back[at[live]]
            put[live] -= 1
            live = live[at[live] > first[live]]
        stray = np.flatnonzero(out == self.v.unknown)
        if len(stray):  # characters outside the vocabulary become their bytes
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in characters[where[stray]].tolist()]
            wide = np.ones(len(out), np.int64)
            wide[stray] = [len(r) for r in raw]
            place = np.cumsum(wide) - wide
            total = np.zeros(len(out) + 1, np.int64)
            np.cumsum(wide, out=total[1:])
            spread = np.repeat(out, wide)
            spots = np.repeat(place[stray], wide[stray]) + np.arange(wide[stray].sum()) - np.repeat(np.cumsum(wide[stray]) - wide[stray], wide[stray])
            spread[spots] = self.v.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            out, offsets = spread, total[offsets]
        return out.astype(np.int32), offsets

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the n + 1 offsets of each."""
        known: dict[str, int] = {}
        used, count = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                own = SEGMENT.findall(SPACE + text.replace(" ", SPACE))
                used.append(np.fromiter((known.setdefault(s, len(known)) for s in own), np.int64, len(own)))
                count[k] = len(own)
        offsets = np.zeros(len(texts) + 1, np.int64)
        if not known:
            return np.zeros(0, np.int32), offsets
        flat, at = self._segments(list(known))
        of = np.concatenate(used)
        size = (at[1:] - at[:-1])[of]
        ids = gathered(flat, at[:-1][of], size)
        ends = np.concatenate(([0], np.cumsum(size)))
        offsets[1:] = ends[np.cumsum(count)]
        return ids, offsets


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` one after another."""
    out_start = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - out_start, sizes) + np.arange(int(sizes.sum()))]


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of ids: pieces' bytes joined, the mark in front dropped."""
    size = v.shown_size[ids]
    data = gathered(v.shown, v.shown_at[ids], size).tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))[offsets]
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        text = data[a:b].decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def encode_documents(docs: DataFrame, text: str = "text", model: str = MODEL, keep_text: bool = True) -> DataFrame:
    """``docs`` with ids (array<int>), n_pieces (long) and round_trip (boolean:
    the decoded ids give the text again, a mark counting as a space)."""
    own = docs.drop("ids", "n_pieces", "round_trip")
    own = own.withColumn(text, F.col(text).cast("string"))
    names = own.columns
    kept = [c for c in names if keep_text or c != text]
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        v = held.value
        encoder = Encoder(v)
        for piece in common.pieces(batches, text, BATCH_BYTES):
            texts = [t or "" for t in piece.column(names.index(text)).to_pylist()]
            ids, offsets = encoder.encode(texts)
            same = [a.replace(SPACE, " ") == b for a, b in zip(texts, decode(v, ids, offsets), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(names.index(c)) for c in kept), lists, pa.array(np.diff(offsets), pa.int64()), pa.array(same)],
                [*kept, "ids", "n_pieces", "round_trip"])

    fields = [f for f in own.schema.fields if f.name in kept]
    return own.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                                             T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())]))


def decode_documents(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``encoded`` with text: the ids decoded; null ids give an empty text."""
    own = encoded.drop("text")
    names, held = own.columns, encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        for batch in batches:
            lists = batch.column(names.index(ids)).to_pylist()
            flat = np.array([i for x in lists for i in (x or ())], np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(x or ()) for x in lists]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decode(held.value, flat, offsets), pa.string())], [*names, "text"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("text", T.StringType())]))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: ids, their number, the round trip."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
