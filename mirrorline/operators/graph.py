"""Frontier, visited set and reachability over the link graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, written

#: Links of one source beyond which its edges are spread, and over how many parts.
HOT_LINKS = 100_000
HOT_PARTS = 64


def frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Discovered URLs (per site) not yet visited."""
    found = links.select("site", F.col("dst_url").alias("url")).distinct()
    return found.join(visited.select("site", "url"), ["site", "url"], "left_anti")


def visited_union(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("site", "url").unionByName(new.select("site", "url")).distinct()


def asset_dedupe(assets: DataFrame) -> DataFrame:
    """Each asset URL taken once per site across all pages of a run."""
    return assets.dropDuplicates(["site", "url"])


def _bucketed(rows: DataFrame, name: str, buckets: int, keys: list[str]):
    """Writer of a table in the shared folder, hash-partitioned on ``keys``: one
    file per bucket and write, as its rows are dealt that way first."""
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/{name}"
    return (rows.repartition(buckets, *keys).write.format("parquet").option("path", path)
            .bucketBy(buckets, *keys).sortBy(*keys))


def reachable(edges: DataFrame, seeds: DataFrame, hot: int = HOT_LINKS, parts: int = HOT_PARTS) -> DataFrame:
    """URLs reachable from the seeds, with ``depth`` = fewest hops.

    Semi-naive iteration over two bucketed tables in the shared folder: the edges,
    written once by (source, part), and the URLs seen, to which every round appends
    its own partition. A round reads its predecessor's partition only, shuffles those
    URLs and the targets found, and anti-joins them with all seen before; neither the
    edges nor the URLs seen move again, and the plan is the same size in every round.
    A source of over ``hot`` links lies in ``parts`` buckets, and is asked for in each.
    It ends when a round adds nothing (cycles end because every URL enters once).
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"reach_{uuid.uuid4().hex}"
    e = edges.select("src_url", "dst_url").where(F.col("src_url").isNotNull() & F.col("dst_url").isNotNull())
    large = written(e.groupBy("src_url").agg(F.count("*").alias("n")).where(F.col("n") > hot)
                    .select("src_url", F.lit(parts).alias("parts")))
    spread = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("dst_url"), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    e = e.join(large, "src_url", "left").select("src_url", spread.alias("part"), "dst_url")
    asked = large.withColumnRenamed("src_url", "url")
    try:
        # a pair has one place, so doubles go within the buckets, without a shuffle of their own
        (_bucketed(e.repartition(n, "src_url", "part").distinct(), f"{name}/edges", n, ["src_url", "part"])
         .saveAsTable(f"{name}_edges"))
        found, depth = seeds.select("url").where("url is not null").distinct(), 0
        while True:
            (_bucketed(found.withColumn("depth", F.lit(depth)), f"{name}/seen", n, ["url"])
             .partitionBy("depth").mode("append").saveAsTable(f"{name}_seen"))
            seen = spark.table(f"{name}_seen")
            newest = seen.where(F.col("depth") == depth).select("url")
            if newest.isEmpty():
                break
            found = _step(newest.join(asked, "url", "left"), spark.table(f"{name}_edges"), seen)
            depth += 1
        return spark.read.schema("url string, depth int").parquet(f"{ensure_checkpoint_dir(spark)}/{name}/seen")
    finally:  # the names only: the folders are read by path
        spark.sql(f"drop table if exists {name}_edges")
        spark.sql(f"drop table if exists {name}_seen")


def _step(newest: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Targets of the newest URLs (with their number of ``parts``) that were not seen yet."""
    ask = newest.select(F.col("url").alias("src_url"),
                        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"))
    targets = edges.join(ask, ["src_url", "part"], "left_semi").select(F.col("dst_url").alias("url")).distinct()
    return targets.join(seen.select("url"), "url", "left_anti")
