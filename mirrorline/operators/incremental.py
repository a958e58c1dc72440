"""A crawl round on top of the stored manifest: only its captures are read.

Links and hashes are worked out for the round's captures alone; everything about
earlier rounds comes from the manifest's narrow tables (URLs, hashes), never
from a body. The joins are equi-joins on (site, url) between those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.captures import successful
from ..sources.manifest_store import ManifestStore
from .extract import extract_links
from .graph import visited_union
from .manifest import manifest_record, manifest_touch, plan_incremental
from .rewrite import build_mirror
from .robots import robots_filter


def record_round(store: ManifestStore, round_id: int, captures: DataFrame, runs: DataFrame | None = None, asked: DataFrame | None = None) -> bool:
    """Add a round's captures to the manifest; False if it had been added before.
    URLs that were ``asked`` for (site, url) are visited, answered or not."""
    ok = successful(captures)
    entries = manifest_record(build_mirror(ok))
    found = extract_links(ok).select("site", F.col("dst_url").alias("url")).distinct()
    visited = captures.select(U.parsed("url").alias("u")).where("u is not null").select(
        U.site_of(F.col("u.host")).alias("site"), U.serialize(F.col("u")).alias("url")).distinct()
    if asked is not None:
        visited = visited_union(visited, asked)
    if runs is not None:
        runs = manifest_touch(store.read("runs"), runs)
    return store.append(round_id, runs=runs, entries=entries, found=found, visited=visited)


def next_round(store: ManifestStore, rules: DataFrame) -> DataFrame:
    """One decision for every URL captured or linked to so far (see
    ``plan_incremental``): what the next round fetches, from stored tables only."""
    visited = store.read("visited")
    discovered = visited_union(visited, store.read("found"))
    entries = store.read("entries").select("site", "url", F.lit(False).alias("fresh"), "rtype")
    paths = discovered.select("site", "url", U.parsed("url")["path"].alias("path"))
    return plan_incremental(discovered, visited, entries, robots_filter(paths, rules))
