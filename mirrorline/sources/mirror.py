"""Mirror storage: write/scan the mirror table and bundle totals.

A mirror holds one file per (site, path). URLs that map to the same path (www
and bare host, http and https) compete: the capture of highest seq is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: Name of a manifest file kept beside the stored files; never part of a bundle.
MANIFEST_FILE = "mirror-manifest.json"

#: Rows of one path beyond which its losers are left behind before bodies move.
CROWD = 1000
#: Rows of a site beyond which its files are dealt over several partitions.
SITE_FILES = 2_000

_FILE = ["url", "rtype", "content", "size", "hash", "out_hash", "seq"]


def crowded_paths(rows: DataFrame, crowd: int) -> DataFrame:
    """Paths of over ``crowd`` rows, with the last (seq, url) of each."""
    return (rows.groupBy("site", "path").agg(F.count("*").alias("n"), F.max(F.struct("seq", "url")).alias("last"))
            .where(F.col("n") > crowd).select("site", "path", "last"))


def large_sites(rows: DataFrame, site_files: int) -> DataFrame:
    """Sites of over ``site_files`` rows, with the number of shards for that many in each."""
    return (rows.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") > site_files)
            .select("site", F.ceil(F.col("n") / site_files).alias("shards")))


def stored_files(mirror: DataFrame, crowd: int = CROWD, site_files: int = SITE_FILES) -> DataFrame:
    """One row per (site, path): the winner of those that map to it, laid out by
    site and path.

    Bodies move once. Counts are made on narrow columns, so nothing is rewritten for
    them; losers of a path of over ``crowd`` rows go before the move, and sites of over
    ``site_files`` rows are split by path. Both lists have at most one row per so many
    rows of the mirror; they are written first, so the joins choose their form by size. Rows of a
    path then meet in one partition, where the first in order is kept; equal (seq, url)
    are decided by the stored content's hash.
    """
    rows = mirror.select("site", F.col("offline_path").alias("path"), *_FILE)
    rank = F.struct("seq", "url")
    kept = (rows.join(written(crowded_paths(rows, crowd)), ["site", "path"], "left")
            .where(F.col("last").isNull() | rank.eqNullSafe(F.col("last")))
            .join(written(large_sites(rows, site_files)), "site", "left"))
    shard = F.pmod(F.xxhash64("path"), F.coalesce("shards", F.lit(1))).alias("shard")
    dealt = kept.select("site", "path", shard, *_FILE).repartition("site", "shard")
    order = Window.partitionBy("site", "path", "shard").orderBy(F.desc("seq"), F.desc("url"), F.desc("out_hash"))
    return dealt.withColumn("_at", F.row_number().over(order)).where("_at = 1").select("site", "path", *_FILE)


def write_mirror(mirror: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The stored files as Parquet, sorted by (site, path) in every file: a small
    site lies in one file, a large one spans several."""
    stored_files(mirror).write.mode(mode).parquet(path)


def scan_mirror(spark: SparkSession, path: str) -> DataFrame:
    """Files of a written mirror: site, path, content and what was recorded."""
    return spark.read.parquet(path)


def _in_bundle(manifest_file: str):
    return F.regexp_extract(F.col("path"), r"([^/]*)$", 1) != manifest_file


def bundle_totals(mirror: DataFrame, manifest_file: str = MANIFEST_FILE) -> DataFrame:
    """Per site: files and bytes a bundle holds (manifest file excluded at any
    depth). The winner per path is chosen on sizes, without the content."""
    sized = mirror.select("site", F.col("offline_path").alias("path"), "url", "seq",
                          F.octet_length(F.col("content")).cast("bigint").alias("bytes"))
    files = sized.groupBy("site", "path").agg(F.max_by("bytes", F.struct("seq", "url")).alias("bytes"))
    return (files.where(_in_bundle(manifest_file))
            .groupBy("site").agg(F.count("*").alias("files"), F.sum("bytes").cast("bigint").alias("bytes")))


def write_bundle(mirror: DataFrame, path: str, codec: str = "zstd", manifest_file: str = MANIFEST_FILE) -> None:
    """Compressed bundle of the stored files (Parquet, ordered by site and
    path). The archive container format itself is not produced."""
    files = stored_files(mirror).where(_in_bundle(manifest_file)).select("site", "path", "content")
    files.write.mode("overwrite").option("compression", codec).parquet(path)
