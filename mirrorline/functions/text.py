"""Scalar helpers: content hash and the human byte formatter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hash prefix and byte units of the reference's output.
HASH_PREFIX = "sha256:"
BYTE_UNITS = ("B", "KB", "MB", "GB")


def content_hash(body: Column) -> Column:
    """'sha256:' + 64 lower-case hex digits of the UTF-8 bytes (or binary)."""
    return F.concat(F.lit(HASH_PREFIX), F.sha2(body, 256))


def byte_size(body: Column) -> Column:
    return F.octet_length(body).cast("bigint")


def format_bytes(n: Column) -> Column:
    """1024-based B/KB/MB/GB with one decimal above B; steps up only when the
    value is strictly above 1024. Rounds the exact quotient half-to-even with
    integer arithmetic, so no floating-point formatting is involved."""
    b = n.cast("decimal(38,0)")
    k = F.lit(1024).cast("decimal(38,0)")
    unit = (F.when(b <= k, 0).when(b <= k * k, 1).when(b <= k * k * k, 2).otherwise(3))
    d = (F.when(unit == 1, k).when(unit == 2, k * k).otherwise(k * k * k)).cast("decimal(38,0)")
    tenths_num = b * 10
    q = F.floor(tenths_num / d).cast("decimal(38,0)")
    r = tenths_num - q * d
    up = (r * 2 > d) | ((r * 2 == d) & (F.pmod(q, F.lit(2)) == 1))
    t = (q + F.when(up, 1).otherwise(0)).cast("bigint")
    name = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), (unit + 1).cast("int"))
    return (F.when(n.isNull(), F.lit(None))
            .when(unit == 0, F.concat(n.cast("string"), F.lit(" B")))
            .otherwise(F.concat((t / 10).cast("bigint").cast("string"), F.lit("."),
                                F.pmod(t, F.lit(10)).cast("string"), F.lit(" "), name)))
