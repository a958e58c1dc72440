"""URL dimension and offline-path collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def url_dim(df: DataFrame, url_col: str = "url", content_type_col: str | None = "content_type",
            seq_col: str | None = "seq", size: Column | None = None) -> DataFrame:
    """One row per canonical URL: scheme, host, site, path, query, type and
    offline path. Several inputs mapping to one canonical URL (fragments,
    case of scheme/host, default ports) keep the one with the highest seq.
    ``size``: an expression over ``df`` to carry along as a column."""
    ct = F.col(content_type_col) if content_type_col else F.lit(None).cast("string")
    seq = F.col(seq_col) if seq_col else F.lit(0).cast("bigint")
    parsed = (df.select(U.parse_absolute(F.col(url_col)).alias("u"), ct.alias("content_type"), seq.alias("seq"),
                        *([] if size is None else [size.alias("size")]))
              .where(F.col("u").isNotNull()))
    rows = parsed.select(
        U.serialize(F.col("u")).alias("url"),
        F.col("u.scheme").alias("scheme"), F.col("u.host").alias("host"),
        U.site_of(F.col("u.host")).alias("site"),
        F.col("u.path").alias("path"), F.col("u.query").alias("query"),
        U.classify_resource(F.col("content_type"), F.col("u.path")).alias("rtype"),
        U.offline_path(F.col("u.path"), F.col("u.query")).alias("offline_path"),
        F.col("seq"), *([] if size is None else ["size"]))
    cols = ["scheme", "host", "site", "path", "query", "rtype", "offline_path", "seq"] + ([] if size is None else ["size"])
    best = rows.groupBy("url").agg(F.max_by(F.struct(*cols), F.struct("seq", *[c for c in cols if c != "seq"])).alias("b"))
    return best.select("url", *[F.col(f"b.{c}").alias(c) for c in cols])


def path_collisions(dim: DataFrame) -> DataFrame:
    """Offline files that more than one distinct URL maps to, per site, with
    the URL whose capture is latest (the one a mirror would keep)."""
    return (dim.groupBy("site", "offline_path")
            .agg(F.count_distinct("url").alias("n_urls"),
                 F.max_by("url", F.struct("seq", "url")).alias("winner"),
                 F.min("url").alias("first_url"))
            .where(F.col("n_urls") > 1))
