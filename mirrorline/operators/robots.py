"""robots.txt rules and URL filters.

Rules meet URLs in a prefix index (see ``robots_filter``); AQE turns its joins
into broadcasts only when the runtime size allows it, and splits hot sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import nstruct, trim_ws

# The only section honoured, and the field names (case-sensitive).
AGENT_FIELD = "User-agent:"
DISALLOW_FIELD = "Disallow:"
ALLOW_FIELD = "Allow:"
NOISE_PREFIXES = ("/cdn-cgi/",)
NOISE_CONTAINS = ("/__cf_", "cloudflareinsights")
NOISE_SUFFIXES = ("/rum",)


def robots_rules(robots: DataFrame) -> DataFrame:
    """robots(site, body) -> rules(site, line, allow, prefix) of the
    ``User-agent: *`` sections. Each agent line replaces the current section;
    blank and '#' lines are skipped; empty values are ignored."""
    lines = (robots.where(F.col("body").isNotNull())
             .select("site", F.posexplode(F.split(F.col("body"), "\n")).alias("line", "raw"))
             .withColumn("text", trim_ws(F.col("raw")))
             .where((F.col("text") != "") & ~F.col("text").startswith("#")))
    agent = F.when(F.col("text").startswith(AGENT_FIELD),
                   trim_ws(F.substr(F.col("text"), F.lit(len(AGENT_FIELD) + 1))) == "*")
    w = Window.partitionBy("site").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("agent", agent).withColumn(
        "universal", F.coalesce(F.last("agent", ignorenulls=True).over(w), F.lit(False)))
    dis = trim_ws(F.substr(F.col("text"), F.lit(len(DISALLOW_FIELD) + 1)))
    alw = trim_ws(F.substr(F.col("text"), F.lit(len(ALLOW_FIELD) + 1)))
    rule = (F.when(F.col("text").startswith(DISALLOW_FIELD), nstruct(allow=F.lit(False), prefix=dis))
            .when(F.col("text").startswith(ALLOW_FIELD), nstruct(allow=F.lit(True), prefix=alw)))
    return (marked.where(F.col("agent").isNull() & F.col("universal"))
            .select("site", F.col("line").cast("int").alias("line"), rule.alias("r"))
            .where(F.col("r").isNotNull() & (F.col("r.prefix") != ""))
            .select("site", "line", F.col("r.allow").alias("allow"), F.col("r.prefix").alias("prefix")))


def robots_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("site").agg(F.count_if(~F.col("allow")).alias("disallows"),
                                     F.count_if(F.col("allow")).alias("allows"))


def robots_filter(urls: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds ``allowed``: the longest matching prefix decides, an Allow wins a tie,
    no matching rule (or no robots file) allows.

    A prefix index instead of a scan of a site's rules: every distinct path is cut
    at the lengths that its site's prefixes have, and the pieces meet the
    prefixes by an equi-join on (site, prefix). The only array is a site's list of
    distinct lengths, which n bytes of robots file hold less than 1.5 * sqrt(n) of."""
    index = rules.groupBy("site", "prefix").agg(F.bool_or("allow").alias("_allow"))
    lengths = index.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    paths = urls.select("site", F.col(path_col).alias("_path")).distinct()
    cut = (paths.join(lengths, "site")
           .select("site", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n"))
           .select("site", "_path", "_n", F.substr("_path", F.lit(1), F.col("_n")).alias("prefix")))
    verdict = cut.join(index, ["site", "prefix"]).groupBy("site", "_path").agg(F.max_by("_allow", "_n").alias("_allow"))
    verdict = verdict.select(F.col("site").alias("_site"), "_path", "_allow")
    return (urls.join(verdict, (urls["site"] == verdict["_site"]) & (urls[path_col] == verdict["_path"]), "left")
            .withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_site", "_path", "_allow"))


def is_noise(path):
    cond = F.lit(False)
    for p in NOISE_PREFIXES:
        cond = cond | path.startswith(p)
    for c in NOISE_CONTAINS:
        cond = cond | path.contains(c)
    for s in NOISE_SUFFIXES:
        cond = cond | path.endswith(s)
    return cond


def is_route(path):
    """Last segment without a dot, or a .html/.htm path (lower-cased)."""
    lp = F.lower(path)
    last = F.regexp_extract(lp, r"([^/]*)$", 1)
    return ~last.contains(".") | lp.endswith(".html") | lp.endswith(".htm")


def noise_filter(df: DataFrame, path_col: str = "path") -> DataFrame:
    return df.where(~is_noise(F.col(path_col)))


def route_filter(df: DataFrame, path_col: str = "path") -> DataFrame:
    return df.where(is_route(F.col(path_col)))
