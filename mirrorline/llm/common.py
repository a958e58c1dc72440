"""Shared helpers of the training-data operators: table access, reliable
checkpoints, and byte-level views of Arrow text columns."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: Text bytes that a Python task looks at in one piece (a longer text is one piece).
PIECE_BYTES = 2 << 20

# Word classes of the query contracts, as byte tables of UTF-8
# (every byte from 0x80 belongs to a non-ASCII character, a word character).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if
    it is not installed (a path that an executor lacks does no harm)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint in the shared
    folder; lineage is cut there and a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read
    back: for wide rows, which a checkpoint would keep uncompressed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(batches, keys: list[str], rows: int):
    """Tables of about ``rows`` rows out of batches sorted by ``keys``, each
    holding whole groups of equal keys only."""
    held, n = [], 0

    def last_cut(t: pa.Table) -> int:
        differ = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            c = t.column(k).to_numpy()
            differ |= c != c[-1]
        at = np.flatnonzero(differ)
        return int(at[-1]) + 1 if len(at) else 0

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            cut = last_cut(t)
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n = t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def pieces(batches, column: str, max_bytes: int = PIECE_BYTES):
    """Record batches cut into row ranges of at most ``max_bytes`` of text
    each; one longer text is a piece of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, ends = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start, n = 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1
            stop = min(n, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null
    counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0]: ends[-1]], ends - ends[0]


def word_spans(is_word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends (exclusive) of the maximal runs of word bytes that
    stay inside one row, and each run's row. ``is_word``: a bool per byte."""
    n = len(is_word)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, dtype=bool)
    cut[ends] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    stops = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    return starts, stops, np.searchsorted(ends, starts, side="right") - 1


class SpanHash:
    """64-bit polynomial hashes of byte ranges by prefix sums (arithmetic mod
    2**64 with an odd base, so that powers have inverses), finished by a mixer."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self):
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) >= n:
            return
        base = int(self.BASE)
        back = pow(base, -1, 1 << 64)
        for name, b in (("power", base), ("inverse", back)):
            out = np.empty(n, np.uint64)
            out[0] = 1
            filled = 1
            while filled < n:  # doubling: b**(i + filled) = b**i * b**filled
                step = min(filled, n - filled)
                out[filled: filled + step] = out[:step] * np.uint64(pow(b, filled, 1 << 64))
                filled += step
            setattr(self, name, out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed((sums[stops] - sums[starts]) * self.inverse[starts] + stops.astype(np.uint64) - starts.astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def char_starts(data: np.ndarray) -> np.ndarray:
    """Running count of characters before each byte (n + 1 entries)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
