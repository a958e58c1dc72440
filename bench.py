"""Benchmark: headline jobs over the pages corpus; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Each job
runs into Spark's ``noop`` sink (full execution, no driver collect). Times of
building the DataFrame (with the jobs it runs first), planning it and running the
rest are given apart; the headline value is their sum, and rates are over all of it. A file of one row group cannot be split, so
the input tables are first copied to one file per core, as a large corpus has
many; the copy is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from mirrorline.session import get_spark  # noqa: E402
from mirrorline.plans import queries as Q  # noqa: E402

HEADLINE = ("extract_links", "rewrite_pages", "site_stats", "site_summary", "robots_filter",
            "fetch_outcomes", "url_dim", "spa_features", "reachable", "freshness", "stream_visited", "stream_stats")


def mirror_run(spark, sf):
    """One full batch dataflow: captures -> mirror table on disk -> manifest,
    per-site totals and link counts from the written table."""
    from mirrorline.operators.extract import extract_links
    from mirrorline.operators.rewrite import build_mirror
    from mirrorline.operators.stats import site_stats
    from mirrorline.sources import mirror as MS
    from mirrorline.streaming.jobs import scratch_dir
    caps = Q._caps(spark, sf)
    path = scratch_dir(spark, "bench-mirror")
    MS.write_mirror(build_mirror(caps), path)
    files = MS.scan_mirror(spark, path)
    links = extract_links(caps).groupBy("site").agg(F.count("*").alias("links"))
    entries = files.groupBy("site").agg(F.count("*").alias("entries"))
    stats = site_stats(files.select("site", "rtype", "size"))
    return stats.join(links, "site", "left").join(entries, "site", "left")


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    dealt = tempfile.mkdtemp(prefix="mirrorline-bench-")
    for name in ("pages", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(cpus).write.parquet(f"{dealt}/{name}.parquet")
    pages = spark.read.parquet(f"{dealt}/pages.parquet")
    n_pages = pages.count()
    mb = pages.select(F.sum(F.octet_length("html"))).first()[0] / 1e6
    # warm-up: JVM class loading and code generation for the shared expressions
    Q.q_site_summary(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    jobs = {name: getattr(Q, f"q_{name}") for name in HEADLINE} | {"mirror_run": mirror_run}
    times, parts = {}, {}
    for name, job in jobs.items():
        t = [time.time()]
        df = job(spark, dealt)
        t.append(time.time())
        df._jdf.queryExecution().executedPlan()
        t.append(time.time())
        df.write.format("noop").mode("overwrite").save()
        t.append(time.time())
        parts[name] = [round(b - a, 3) for a, b in zip(t, t[1:], strict=False)]
        times[name] = round(t[-1] - t[0], 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": times,
        "build_plan_run": parts, "input_files": cpus,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": cpus, "pages": n_pages,
        "corpus_mb": round(mb, 3),
        "pages_per_sec": {k: round(n_pages / times[k], 1) for k in ("extract_links", "rewrite_pages", "site_stats", "mirror_run", "stream_stats")},
        "mb_per_sec": {k: round(mb / times[k], 3) for k in ("extract_links", "rewrite_pages", "mirror_run")},
    }))


if __name__ == "__main__":
    main()
