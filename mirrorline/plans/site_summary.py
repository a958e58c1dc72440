"""Flagship: what would an offline mirror of each site contain?

captures -> (typed resources, same-site links) -> per-site totals. A URL captured
more than once counts once, with its latest capture. No body is shuffled: links
are extracted from all captures, and those of earlier ones are dropped by an
equi-join on (URL, seq) of narrow rows. The shuffles key on the URL or (site, target),
well spread even when one site holds most rows; per-site aggregates combine
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators.extract import extract_links
from ..operators.url_dim import url_dim
from ..sources.captures import successful


def site_summary(captures: DataFrame) -> DataFrame:
    ok = successful(captures)
    typed = url_dim(ok, size=TX.byte_size(F.col("body")))
    res = typed.groupBy("site").agg(
        F.count_if(F.col("rtype") == "page").alias("pages"),
        F.count("*").alias("resources"),
        F.sum("size").cast("bigint").alias("bytes"))
    latest = typed.select(F.col("url").alias("src_url"), "seq")
    links = extract_links(ok, carry=("seq",)).join(latest, ["src_url", "seq"], "left_semi")
    # One pass over the links: per target, then per site.
    per_target = links.groupBy("site", "dst_url").agg(F.count("*").alias("n"))
    totals = per_target.groupBy("site").agg(F.sum("n").alias("links"), F.count("*").alias("distinct_targets"))
    out = (res.join(totals, "site", "left")
           .select("site", "pages", "resources", "bytes",
                   F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
                   F.coalesce("distinct_targets", F.lit(0)).cast("bigint").alias("distinct_targets")))
    return out
