"""Vector code compression: product codes of integer vectors, exact throughout.

Components become floor(1024 * x). A vector is cut into equal consecutive
parts, each with a codebook of its own that starts with the first kept vectors
and is refined in rounds: every part is assigned to its nearest entry, and the
entries become the floored means of their parts.

Distances are taken between Walsh-Hadamard transforms. Parts and entries are
padded with zeros to a power of two P and transformed in integers, which turns
a squared distance into P times itself; the squared differences are added up
coefficient by coefficient in sequency order (slowly varying patterns first).
Every few coefficients an entry goes if its sum exceeds the whole distance of
the entry that leads by then; equal sums stay, so ties are decided at the
end, by the lower index.

Codebooks have at most 256 entries, so they and the sums of a round (one per
entry and component) pass through the driver; the vectors never do.

Defined cases: a vector that is null, empty, or holds a null or non-finite
component is dropped, and so is one whose length is not the table's commonest
among those that parts divide (ties: the shorter), or with a component of 2**52
or more, whose integer may not fit a long. Null ids come behind all others and
rows of one id by their vectors; fewer rows than entries give fewer entries; a
sum beyond a long gives a null error; an empty table gives no rows. Extra
columns pass by unread.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = float(2**52)
#: Parts that are compared with a codebook at once, coefficients between two
#: eliminations, and the share (1 / DENSE) of pairs alive below which they are listed.
SLAB, STEP, DENSE = 128, 4, 10


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of that power of two by their sign changes:
    the bit-reversed Gray code."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    out = np.zeros(size, np.int64)
    for k in range(bits):
        out |= ((gray >> k) & 1) << (bits - 1 - k)
    return out


def walsh(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transforms in sequency order of integer rows padded with zeros."""
    n, length = rows.shape
    size = 1 << max(length - 1, 0).bit_length()
    out = np.zeros((n, size), rows.dtype)
    out[:, :length] = rows
    half = 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return out[:, sequency_order(size)]


def exact_type(magnitude: int, length: int):
    """int64 if no squared distance of transforms can pass it, else Python's integers."""
    size = 1 << max(length - 1, 0).bit_length()
    return np.int64 if (2 * size * max(magnitude, 1)) ** 2 * size < 2**63 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of every part's nearest entry; ties to the lower
    index. Integer arrays of rows."""
    length = parts.shape[1]
    magnitude = max((int(np.abs(a).max()) for a in (parts, entries) if a.size), default=0)
    kind = exact_type(magnitude, length)
    code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), kind)
    book = walsh(entries.astype(kind))
    for at in range(0, len(parts), SLAB):
        own = walsh(parts[at: at + SLAB].astype(kind))
        code[at: at + SLAB], error[at: at + SLAB] = _eliminate(own, book)
    return code, error


def _eliminate(own: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries stay side by side while many of them are alive; then only the
    pairs of a part and an entry that are."""
    size, every = own.shape[1], np.arange(len(own))
    columns = np.ascontiguousarray(book.T)
    sums = np.zeros((len(own), len(book)), own.dtype)
    at = 0
    while True:
        to = min(at + STEP, size)
        for s in range(at, to):
            difference = own[:, s, None] - columns[s]
            difference *= difference
            sums += difference
        at = to
        if at == size:
            return np.argmin(sums, axis=1), np.min(sums, axis=1) // size
        leader = np.argmin(sums, axis=1)
        bound = ((own - book[leader]) ** 2).sum(axis=1)
        alive = sums <= bound[:, None]
        if np.count_nonzero(alive) * DENSE < alive.size:
            break
    row, entry = np.nonzero(alive)  # by row, then entry
    sums = sums[row, entry]
    while at < size:
        to = min(at + STEP, size)
        sums = sums + ((own[row, at:to] - book[entry, at:to]) ** 2).sum(axis=1)
        stay = sums <= bound[row]
        row, entry, sums = row[stay], entry[stay], sums[stay]
        at = to
    starts = np.searchsorted(row, every)  # the leader stays, so every row has one
    least = np.minimum.reduceat(sums, starts)
    ties = np.flatnonzero(sums == least[row])
    best = ties[np.searchsorted(row[ties], every)]
    return entry[best], least // size


def integer_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows that are kept, their integers)."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)  # nulls as NaN
    at = np.flatnonzero((np.diff(offsets) == dim) & ~column.is_null().to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.zeros((0, dim), np.int64)
    rows = values[offsets[at][:, None] + np.arange(dim)]
    fine = (np.abs(rows) < LARGEST).all(axis=1)  # false for NaN and infinities
    return at[fine], np.floor(rows[fine] * SCALE).astype(np.int64)


def _summed(books: list[np.ndarray], dim: int):
    """Per task: for every cell (part, entry, position), the sum of the components
    assigned to it and their number."""
    entries, length = books[0].shape

    def run(batches):
        totals = np.zeros((len(books), entries, length), object)
        counts = np.zeros((len(books), entries), np.int64)
        for batch in batches:
            _, rows = integer_rows(batch.column(0), dim)
            if not len(rows):
                continue
            wide = int(np.abs(rows).max()) * len(rows) >= 2**63
            for p, book in enumerate(books):
                parts = rows[:, p * length: (p + 1) * length]
                code, _ = nearest(parts, book)
                sums = np.zeros((entries, length), object if wide else np.int64)
                np.add.at(sums, code, parts.astype(object) if wide else parts)
                totals[p] += sums
                counts[p] += np.bincount(code, minlength=entries)
        used = np.flatnonzero(np.repeat(counts.ravel(), length))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int64()), pa.array([Decimal(int(v)) for v in totals.ravel()[used]], pa.decimal128(38, 0)),
                 pa.array(np.repeat(counts.ravel(), length)[used], pa.int64())], ["cell", "total", "n"])
    return run


def _coded(books: list[np.ndarray], dim: int):
    length = books[0].shape[1]

    def run(batches):
        for batch in batches:
            at, rows = integer_rows(batch.column(2), dim)
            codes, errors = [], np.zeros(len(rows), object)
            for p, book in enumerate(books):
                code, error = nearest(rows[:, p * length: (p + 1) * length], book)
                codes.append(code)
                errors = errors + error.astype(object)
            keys = ["".join(f"{c:02x}" for c in row) for row in zip(*(c.tolist() for c in codes), strict=True)]
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(keys, pa.string()),
                 pa.array([int(e) if e < 2**63 else None for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])
    return run


def _commonest_length(clean: DataFrame, parts: int) -> int | None:
    sizes = clean.groupBy(F.size("embedding").alias("dim")).count().where((F.col("dim") > 0) & (F.col("dim") % parts == 0))
    first = sizes.orderBy(F.desc("count"), "dim").first()
    return first and first["dim"]


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """(one integer codebook per part, the vectors' length); no codebook if no
    vector is kept. vectors(vec_id, embedding)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    clean = vectors.where(F.col("embedding").isNotNull() & ~bad)
    dim = _commonest_length(clean, parts)
    if dim is None:
        return [], 0
    starters = (clean.where(F.size("embedding") == dim)
                .orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect())
    first = np.floor(np.array([r["embedding"] for r in starters], np.float64) * SCALE).astype(np.int64)
    books, length = np.split(first, parts, axis=1), dim // parts
    for _ in range(rounds):
        got = (vectors.select("embedding").mapInArrow(_summed(books, dim), "cell bigint, total decimal(38,0), n bigint")
               .groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())  # at most entries x dim rows
        books = [b.copy() for b in books]
        for r in got:
            entry, position = divmod(r["cell"], length)
            part, entry = divmod(entry, len(first))
            books[part][entry, position] = int(r["total"]) // r["n"]
    return books, dim


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row per
    kept vector. vectors(vec_id, embedding, label)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error bigint"
    numbers = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    books, dim = codebooks(numbers, parts, entries, rounds)
    if not books:
        return vectors.sparkSession.createDataFrame([], schema + ", label_error bigint, codebooks_sha256 string")
    own = stored(numbers.mapInArrow(_coded(books, dim), schema))
    # Sums per label are pre-aggregated; the stored table's size tells whether the join may broadcast it.
    per_label = stored(own.groupBy(F.col("label").alias("_label")).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")))
    return (own.join(per_label, own["label"].eqNullSafe(per_label["_label"]))
            .select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``embeddings`` table."""
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """Plain distances between all parts and entries, in the same rounds."""
    rounds = ""
    for r in range(ROUNDS + 1):
        rounds += f"""
a{r} as (select vec_id, part, min_by(entry, (dist, entry)) as entry, min(dist) as dist from (
  select x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) as dist from x join b{r} b on x.part = b.part and x.pos = b.pos
  group by x.vec_id, x.part, b.entry) group by vec_id, part),"""
        if r < ROUNDS:
            rounds += f"""
m{r} as (select x.part, a.entry, x.pos, sum(x.v) as s, count(*) as n from x join a{r} a on x.vec_id = a.vec_id and x.part = a.part group by x.part, a.entry, x.pos),
b{r + 1} as (select b.part, b.entry, b.pos, case when m.n is null then b.v else cast((m.s - (((m.s % m.n) + m.n) % m.n)) // m.n as bigint) end as v
  from b{r} b left join m{r} m on b.part = m.part and b.entry = m.entry and b.pos = m.pos),"""
    return f"""
with kept as (select vec_id, label, embedding from embeddings where embedding is not null
  and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
x as (select vec_id, label, (i - 1) // (len(embedding) // {PARTS}) as part, (i - 1) % (len(embedding) // {PARTS}) as pos,
  cast(floor({SCALE} * cast(embedding[i] as double)) as bigint) as v
  from (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from kept)),
first as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {ENTRIES}),
b0 as (select x.part, first.entry, x.pos, x.v from x join first on x.vec_id = first.vec_id),{rounds}
own as (select k.vec_id, k.label, string_agg(printf('%02x', a.entry), '' order by a.part) as code, cast(sum(a.dist) as bigint) as error
  from a{ROUNDS} a join kept k on a.vec_id = k.vec_id group by k.vec_id, k.label),
per_label as (select label, cast(sum(error) as bigint) as label_error from own group by label),
book as (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, pos)) as codebooks_sha256 from b{ROUNDS})
select own.vec_id, own.code, own.error, per_label.label_error, book.codebooks_sha256
from own join per_label on own.label is not distinct from per_label.label cross join book
"""


OP13_SQL = _sql()
