"""Manifest maintenance: record, upsert, freshness, incremental plan.

Canonical form is relational: ``manifest_entries(site, url, path, size,
hash, mtime, rtype, out_hash, seq)`` and ``manifest_visited(site, url)``, stored
as Parquet (or JSON lines) ordered by site. Upserts are ``union`` + ``max_by(struct, seq)``
per (site, url): a hash aggregate with map-side combine, no sort.
"""

from __future__ import annotations

import warnings

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX

ENTRY_FIELDS = ["path", "size", "hash", "mtime", "rtype", "out_hash"]


ENTRIES = ("site string, url string, path string, size bigint, hash string, mtime string, rtype string, "
           "out_hash string, seq bigint")


def manifest_record(mirror: DataFrame) -> DataFrame:
    """One entry per saved URL: size and hash of the captured body (as the
    original records them) plus the hash of the stored content. A URL captured
    more than once keeps the capture of highest seq."""
    rows = mirror.select("site", "url", F.col("offline_path").alias("path"), "size", "hash",
                         F.col("last_modified").alias("mtime"), "rtype", "out_hash", "seq")
    return _latest(rows)


def manifest_record_rows(rows: DataFrame) -> DataFrame:
    """The latest of all entries of a URL."""
    return _latest(rows)


def _latest(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("site", "url").agg(
        F.max_by(F.struct(*ENTRY_FIELDS, "seq"), F.struct("seq", "out_hash")).alias("e"))
    return best.select("site", "url", *[F.col(f"e.{c}").alias(c) for c in ENTRY_FIELDS + ["seq"]])


def manifest_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Same key: the entry with the highest seq wins (last write wins)."""
    cols = ["site", "url", *ENTRY_FIELDS, "seq"]
    return _latest(old.select(*cols).unionByName(new.select(*cols)))


def write_manifest(entries: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Entries as Parquet (canonical) or JSON lines, ordered by site and URL so
    that a site's entries lie together, whatever its size."""
    if fmt not in ("parquet", "json"):
        raise ValueError("a manifest is stored as parquet or json")
    rows = entries.select("site", "url", *ENTRY_FIELDS, "seq")
    ordered = rows.repartitionByRange("site", "url").sortWithinPartitions("site", "url")
    ordered.write.mode("overwrite").format(fmt).save(path)


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet", fresh: bool = False) -> DataFrame:
    """Entries of an earlier run. ``fresh`` ignores them; a manifest that is
    missing or cannot be read is warned about and counts as empty, so that the
    run starts afresh."""
    empty = spark.createDataFrame([], ENTRIES)
    if fresh:
        return empty
    try:
        if fmt == "json":
            got = (spark.read.schema(ENTRIES + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path))
            if not got.where("_bad is not null or site is null or url is null").isEmpty():
                raise ValueError("it holds lines that are no entries")
            return got.drop("_bad")
        got = spark.read.parquet(path)
        missing = {f.name for f in empty.schema} - set(got.columns)
        if missing:
            raise ValueError(f"it lacks {sorted(missing)}")
        return got.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema])
    except (ValueError, PySparkException) as why:
        warnings.warn(f"manifest at {path} not used: {str(why).splitlines()[0]}", stacklevel=2)
        return empty


def freshness(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Fresh <=> entry exists, its file exists, and the file's sha-256 equals
    the hash of the stored content. ``files(site, path, content)`` holds a path
    once (as ``scan_mirror`` gives it), so every entry gives one row; instead of the
    content it may hold ``disk_hash`` (as ``tree_digests`` gives it)."""
    digest = F.col("disk_hash") if "disk_hash" in files.columns else TX.content_hash(F.col("content"))
    f = files.select("site", "path", digest.alias("_disk_hash"))
    j = entries.join(f, ["site", "path"], "left")
    return j.withColumn("fresh", F.coalesce(F.col("_disk_hash") == F.col("out_hash"), F.lit(False))).drop("_disk_hash")


def manifest_lookup(urls: DataFrame, entries: DataFrame) -> DataFrame:
    return urls.join(entries.select("site", "url", "rtype", "path"), ["site", "url"], "left")


def plan_incremental(discovered: DataFrame, visited: DataFrame, fresh_entries: DataFrame,
                     allowed: DataFrame | None) -> DataFrame:
    """One decision per discovered (site, url), tested in this order:
    visited -> 'visited'; fresh -> 'fresh'; robots-denied -> 'robots';
    otherwise 'fetch'. ``fresh_entries(site, url, fresh, rtype)``,
    ``allowed(site, url, allowed)``."""
    d = discovered.select("site", "url").distinct()
    v = visited.select("site", "url").distinct().withColumn("_visited", F.lit(True))
    fr = fresh_entries.select("site", "url", F.col("fresh").alias("_fresh"), F.col("rtype").alias("_rtype"))
    j = d.join(v, ["site", "url"], "left").join(fr, ["site", "url"], "left")
    if allowed is not None:
        j = j.join(allowed.select("site", "url", F.col("allowed").alias("_allowed")), ["site", "url"], "left")
    else:
        j = j.withColumn("_allowed", F.lit(True))
    decision = (F.when(F.col("_visited"), F.lit("visited"))
                .when(F.coalesce(F.col("_fresh"), F.lit(False)), F.lit("fresh"))
                .when(~F.coalesce(F.col("_allowed"), F.lit(True)), F.lit("robots"))
                .otherwise(F.lit("fetch")))
    return j.select("site", "url", decision.alias("decision"),
                    F.when(F.col("_fresh"), F.col("_rtype")).alias("rtype"),
                    F.coalesce(F.col("_fresh"), F.lit(False)).alias("fresh"))


def skipped_stats(plan: DataFrame) -> DataFrame:
    """Fresh URLs count towards their type, without bytes."""
    return plan.where(F.col("decision") == "fresh").select("site", "rtype")


def manifest_init(seeds: DataFrame, now: Column | None = None) -> DataFrame:
    """manifest_runs(site, version, start_url, created_at, updated_at), times
    as epoch seconds in text. ``now``: seconds, by default the clock."""
    now = (F.unix_timestamp() if now is None else now).cast("string")
    return seeds.select("site", F.lit(1).alias("version"), F.col("seed_url").alias("start_url"),
                        now.alias("created_at"), now.alias("updated_at"))


def manifest_touch(old: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of an earlier manifest with a new run of the same sites: the start
    URL and creation time stay, ``updated_at`` is that of the new run."""
    o = old.select("site", F.col("version").alias("_v"), F.col("start_url").alias("_s"), F.col("created_at").alias("_c"),
                   F.col("updated_at").alias("_u"))
    j = o.join(runs, "site", "full")
    return j.select("site", F.coalesce("_v", "version").alias("version"), F.coalesce("_s", "start_url").alias("start_url"),
                    F.coalesce("_c", "created_at").alias("created_at"), F.coalesce("updated_at", "_u").alias("updated_at"))
