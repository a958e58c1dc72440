"""Structured Streaming forms of the stateful steps.

A stream of capture files (one file per fetch round) drives:
* ``stream_visited``  - every (site, url) admitted once: ``dropDuplicates``
  without a watermark (state grows like the visited set, so the session keeps
  it in RocksDB).
* ``stream_stats``    - running per-site totals; keyed state per URL takes back what an
  earlier capture of it had added.
* ``stream_manifest`` - manifest upserts in ``foreachBatch``: rounds of the
  manifest store, with compaction, idempotent per batch id.
* ``stream_frontier`` - discovered URLs not in a static visited table
  (stream-static ``left_anti``), deduplicated by state.
The feedback edge of a crawl (new URLs -> next fetch round) is
``operators.crawl.crawl``, a loop of rounds, not one query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import text as TX
from ..functions import urls as U
from ..operators.extract import extract_links
from ..operators.manifest import manifest_record
from ..operators.rewrite import build_mirror
from ..session import ensure_checkpoint_dir
from ..sources.captures import CAPTURES_SCHEMA, successful
from ..sources.manifest_store import ManifestStore


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes of capture files in a micro-batch that is planned and committed as one.
BATCH_BYTES = 1 << 30


def capture_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, bytes_per_batch: int | None = None) -> DataFrame:
    """Capture files as a stream; ``files_per_batch`` or ``bytes_per_batch`` limits a
    micro-batch (one file at least)."""
    reader = spark.readStream.schema(CAPTURES_SCHEMA).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def write_capture_rounds(captures: DataFrame, path: str, rounds: int = 3) -> None:
    """Split captures into ``rounds`` folders (by seq) to replay as a stream.
    Every task writes its own files; no body is moved."""
    for k in range(rounds):
        (captures.where(F.pmod(F.col("seq"), F.lit(rounds)) == k)
         .write.mode("overwrite").parquet(f"{path.rstrip('/')}/round-{k}"))


def _run(query_writer, checkpoint: str):
    q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_visited(spark: SparkSession, source: str, sink: str) -> DataFrame:
    links = extract_links(successful(capture_stream(spark, source)))
    visited = links.select("site", F.col("dst_url").alias("url")).dropDuplicates(["site", "url"])
    _run(visited.writeStream.format("parquet").option("path", sink).outputMode("append"), sink + "_ckpt")
    return spark.read.parquet(sink)


_COUNTS = "site string, pages bigint, images bigint, css bigint, js bigint, total_bytes bigint"
_COUNTED = ("page", "image", "css", "js")


def _changes(key, frames, state):
    """What a URL's new captures change in its site's totals: the latest capture's
    contribution less that of the one before, which the state keeps."""
    import pandas as pd
    seen = state.get if state.exists else None
    best = max((t for f in frames for t in zip(f["seq"].astype("int64"), f["rtype"], f["size"].astype("int64"), strict=True)), default=None)
    if best is None or (seen is not None and tuple(seen) >= best):
        return
    state.update(tuple(map(lambda v: v if isinstance(v, str) else int(v), best)))
    row = [int(best[1] == t) - int(seen is not None and seen[1] == t) for t in _COUNTED] + [int(best[2]) - (int(seen[2]) if seen is not None else 0)]
    yield pd.DataFrame([[key[0], *row]], columns=["site", "pages", "images", "css", "js", "total_bytes"])


def stream_stats(spark: SparkSession, source: str, sink: str) -> DataFrame:
    """Running totals per site, in which a URL counts once, with its latest capture,
    in whatever order captures come. Keyed state holds each URL's contribution
    (sequence, type, size); a later capture retracts it. A batch's changes are
    summed per site and overwrite the batch's own partition, so a replayed batch
    changes nothing; the totals are the sums over all batches."""
    caps = successful(capture_stream(spark, source))
    typed = (caps.select(U.parsed("url").alias("u"), "content_type", "body", "seq")
             .where(F.col("u").isNotNull())
             .select(U.site_of(F.col("u.host")).alias("site"), U.serialize(F.col("u")).alias("url"),
                     U.classify_resource(F.col("content_type"), F.col("u.path")).alias("rtype"),
                     TX.byte_size(F.col("body")).alias("size"), "seq"))
    changes = typed.groupBy("site", "url").applyInPandasWithState(
        _changes, _COUNTS, "seq bigint, rtype string, size bigint", "update", GroupStateTimeout.NoTimeout)
    totals = [F.sum(c).cast("bigint").alias(c) for c in ("pages", "images", "css", "js", "total_bytes")]

    def keep(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy("site").agg(*totals).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))

    _run(changes.writeStream.outputMode("update").foreachBatch(keep), sink + "_ckpt")
    return spark.read.parquet(sink).groupBy("site").agg(*totals)


def stream_manifest(spark: SparkSession, source: str, sink: str) -> DataFrame:
    """Manifest upserts: each micro-batch is a round of the manifest store, added as
    deltas that are folded into a new base every few batches. A replayed batch is
    known by its id, so it changes nothing; a read costs the live entries and a
    bounded number of deltas. A micro-batch is bounded by bytes, not by files: the
    number of batches, each planned, committed and folded, does not follow the number
    of files, and a batch has work for every core."""
    caps = successful(capture_stream(spark, source, bytes_per_batch=BATCH_BYTES))
    store = ManifestStore(spark, sink)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        store.append(batch_id, entries=manifest_record(build_mirror(batch)))

    _run(caps.writeStream.foreachBatch(upsert), sink + "_ckpt")
    return store.read("entries")


def stream_frontier(spark: SparkSession, source: str, visited: DataFrame, sink: str) -> DataFrame:
    known = scratch_dir(spark, "known")  # computed once, not again in every micro-batch
    visited.select("site", "url").distinct().write.parquet(known)
    links = extract_links(successful(capture_stream(spark, source)))
    found = links.select("site", F.col("dst_url").alias("url"))
    new = found.join(spark.read.parquet(known), ["site", "url"], "left_anti").dropDuplicates(["site", "url"])
    _run(new.writeStream.format("parquet").option("path", sink).outputMode("append"), sink + "_ckpt")
    return spark.read.parquet(sink)
