"""Per-site totals (partial + final hash aggregates keyed by site)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX

COUNTED_TYPES = ("page", "image", "css", "js")


def site_stats(mirror: DataFrame, errors: DataFrame | None = None,
               skipped: DataFrame | None = None) -> DataFrame:
    """pages/images/css/js counts and total bytes of the saved resources, plus
    skipped-as-fresh resources (counted, no bytes) and failed URLs.

    ``mirror(site, rtype, size)``, ``skipped(site, rtype)``, ``errors(site)``.
    """
    parts = [mirror.select("site", "rtype", F.col("size").cast("bigint").alias("size"),
                           F.lit(0).alias("err"))]
    if skipped is not None:
        parts.append(skipped.select("site", "rtype", F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("err")))
    if errors is not None:
        parts.append(errors.select("site", F.lit(None).cast("string").alias("rtype"),
                                   F.lit(0).cast("bigint").alias("size"), F.lit(1).alias("err")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    agg = u.groupBy("site").agg(
        F.count_if(F.col("rtype") == "page").alias("pages"),
        F.count_if(F.col("rtype") == "image").alias("images"),
        F.count_if(F.col("rtype") == "css").alias("css"),
        F.count_if(F.col("rtype") == "js").alias("js"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.sum("err").cast("bigint").alias("errors"))
    return agg.withColumn("size_text", TX.format_bytes(F.col("total_bytes")))
