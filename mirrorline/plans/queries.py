"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the whole given tables (or data Spark derives from them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import extract as X
from ..operators.url_dim import path_collisions, url_dim
from ..sources import derived as D
from ..sources.captures import captures_from_pages, read_table, successful
from .site_summary import site_summary


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages")


def q_site_summary(spark, sf):
    return site_summary(D.repeated_captures(captures_from_pages(_pages(spark, sf))))


def q_url_dim(spark, sf):
    return url_dim(D.mixed_captures(_pages(spark, sf)))


def q_host_forms(spark, sf):
    """Addresses in every form a host may take, each with the link of its page."""
    odd = D.odd_addresses(_pages(spark, sf))
    u = odd.select("page_id", U.parsed("url").alias("u"))
    links = X.extract_links(captures_from_pages(odd)).select(F.col("src_url").alias("url"), "dst_url")
    own = u.select("page_id", U.serialize(F.col("u")).alias("url"), U.site_of(F.col("u.host")).alias("site"))
    return own.join(links, "url", "left").select("page_id", "url", "site", "dst_url")


def q_path_collisions(spark, sf):
    return path_collisions(url_dim(D.mixed_captures(_pages(spark, sf)))).select(
        "site", "offline_path", "n_urls", "winner")


def q_extract_links(spark, sf):
    return X.extract_links(successful(captures_from_pages(D.enriched_html(_pages(spark, sf)))))


def q_extract_srcset(spark, sf):
    return X.extract_srcset(successful(captures_from_pages(D.enriched_html(_pages(spark, sf)))))


def q_rewrite_pages(spark, sf):
    from ..operators.rewrite import build_mirror
    m = build_mirror(successful(captures_from_pages(D.enriched_html(_pages(spark, sf)))))
    return m.where("rtype = 'page'").select("url", "offline_path", "content", "size", "hash",
                                            "out_size", "out_hash")


def q_strip_offline_breakers(spark, sf):
    from pyspark.sql import functions as F
    from ..functions import html as H
    p = D.enriched_html(_pages(spark, sf))
    out = p.select("page_id", "html", H.without_breakers(F.col("html")).alias("out"))

    def count(rule):
        return F.size(F.filter("out.removed", lambda r: r == rule)).cast("bigint").alias(rule)
    return out.select("page_id", F.col("out.html").alias("html"),
                      (F.length("html") - F.length("out.html")).cast("bigint").alias("removed_chars"), *map(count, H.BREAKER_RULES))


def q_strip_scripts(spark, sf):
    from pyspark.sql import functions as F
    from ..functions import html as H
    p = D.enriched_html(_pages(spark, sf))
    return p.select("page_id", H.strip_scripts(F.col("html")).alias("html"))


def q_visible_text(spark, sf):
    from pyspark.sql import functions as F
    from ..functions import html as H
    from ..functions.urls import WS
    t = H.visible_text(F.col("html"))
    return _pages(spark, sf).select(
        "page_id", t.alias("text"),
        F.length(F.regexp_replace(t, f"[{WS}]", "")).cast("bigint").alias("visible_chars"))


# ---------------------------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from ..functions import text as TX  # noqa: E402
from ..functions import urls as U  # noqa: E402
from ..operators import fetchlog as FL  # noqa: E402
from ..operators import graph as G  # noqa: E402
from ..operators import manifest as M  # noqa: E402
from ..operators import robots as RB  # noqa: E402
from ..operators import spa as S  # noqa: E402
from ..operators.stats import site_stats  # noqa: E402

SEED_MODES = ("auto", "on", "off", "AUTO", "Yes", "bogus")


def _caps(spark, sf):
    return captures_from_pages(_pages(spark, sf))


def _rules(spark, sf):
    return RB.robots_rules(D.robots_texts(_pages(spark, sf)))


def _page_urls(spark, sf):
    return url_dim(_caps(spark, sf)).select("site", "url", "path", "rtype", "offline_path")


def _seeds(spark, sf):
    p = _pages(spark, sf).select(U.parsed("url").alias("u"), "page_id", "url")
    first = p.groupBy(U.site_of(F.col("u.host")).alias("site")).agg(F.min_by("url", "page_id").alias("seed_url"))
    mode = F.element_at(F.array(*[F.lit(m) for m in SEED_MODES]),
                        (F.pmod(F.length("site"), F.lit(len(SEED_MODES))) + 1).cast("int"))
    return first.select("site", "seed_url", mode.alias("mode"))


def q_robots_rules(spark, sf):
    return _rules(spark, sf)


def q_robots_counts(spark, sf):
    return RB.robots_counts(_rules(spark, sf))


def q_robots_filter(spark, sf):
    return RB.robots_filter(_page_urls(spark, sf).select("site", "url", "path"), _rules(spark, sf))


NOISE_PATHS = ("/cdn-cgi/rum?x=1", "/a/__cf_bm", "/beacon/rum", "/js/cloudflareinsights.js", "/ok/app.js",
               "/Docs/Guide.HTML", "/docs/v1.2/")


def _asset_candidates(spark, sf):
    p = _pages(spark, sf).select(U.parsed("url").alias("u"))
    paths = F.concat(F.array(F.col("u.path")), F.array(*[F.lit(x) for x in NOISE_PATHS]))
    return p.select(U.site_of(F.col("u.host")).alias("site"), F.col("u.host").alias("host"),
                    F.explode(paths).alias("path"))


def q_noise_filter(spark, sf):
    return RB.noise_filter(_asset_candidates(spark, sf))


def q_route_filter(spark, sf):
    return RB.route_filter(_asset_candidates(spark, sf))


def _links(spark, sf):
    return X.extract_links(_caps(spark, sf))


def _old_visited(spark, sf, links=None):
    """Visited set of an earlier run: link targets of every fourth page, and a
    URL of every page's site that no page links to any more. ``links``: the links
    of all pages with their page's ``seq``, if they are at hand."""
    pages = _pages(spark, sf)
    if links is None:
        old = X.extract_links(captures_from_pages(pages.where(F.pmod(F.col("page_id"), F.lit(4)) == 0)))
    else:
        old = links.where(F.pmod(F.col("seq"), F.lit(4)) == 0)
    gone = pages.select(U.parsed("url").alias("u"), "page_id").select(
        U.site_of(F.col("u.host")).alias("site"),
        F.concat(F.lit("https://"), F.col("u.host"), F.lit("/gone/"), F.col("page_id").cast("string")).alias("url"))
    return old.select("site", F.col("dst_url").alias("url")).unionByName(gone)


def q_frontier(spark, sf):
    return G.frontier(_links(spark, sf), _old_visited(spark, sf))


def q_visited_union(spark, sf):
    new = _links(spark, sf).select("site", F.col("dst_url").alias("url"))
    return G.visited_union(_old_visited(spark, sf), new)


def q_asset_dedupe(spark, sf):
    l = X.extract_links(captures_from_pages(D.enriched_html(_pages(spark, sf))))
    assets = l.where(F.col("tag") != "a").select("site", F.col("dst_url").alias("url"), "tag", "attr")
    return G.asset_dedupe(assets).select("site", "url")


def q_reachable(spark, sf):
    pages = _pages(spark, sf)
    edges = D.graph_edges(pages)
    seeds = pages.where(F.col("page_id") == 0).select("url")
    return G.reachable(edges, seeds)


def q_fetch_outcomes(spark, sf):
    return FL.fetch_outcomes(D.attempts_from_events(read_table(spark, sf, "events")))


def q_error_stats(spark, sf):
    return FL.error_stats(FL.fetch_outcomes(D.attempts_from_events(read_table(spark, sf, "events"))))


def q_site_stats(spark, sf):
    """Totals of a run over mixed captures: saved resources by type and bytes
    (a URL counts once), failed responses (non-200) as errors."""
    caps = D.repeated_captures(D.mixed_captures(_pages(spark, sf)))
    saved = url_dim(successful(caps), size=TX.byte_size(F.col("body")))
    errors = caps.where(F.col("status") != 200).select(
        U.site_of(U.parsed("url")["host"]).alias("site"))
    return site_stats(saved.select("site", "rtype", "size"), errors=errors)


def q_run_stats(spark, sf):
    """Totals of a run whose errors come from the attempt log."""
    caps = D.mixed_captures(_pages(spark, sf))
    saved = url_dim(successful(caps), size=TX.byte_size(F.col("body")))
    failed = FL.fetch_outcomes(D.attempts_from_events(read_table(spark, sf, "events"))).where(F.col("outcome").isin("failed", "exhausted"))
    return site_stats(saved.select("site", "rtype", "size"),
                      errors=failed.select(U.site_of(U.parsed("url")["host"]).alias("site")))


def q_format_bytes(spark, sf):
    ev = read_table(spark, sf, "events")
    n = (F.col("event_id") * F.col("event_id") * 7919 + F.col("user_id")).cast("bigint")
    vals = ev.select(F.col("event_id"), n.alias("n"))
    return vals.select("event_id", "n", TX.format_bytes(F.col("n")).alias("text"))


def q_spa_features(spark, sf):
    f = S.spa_features(D.spa_html(_pages(spark, sf)))
    return f.select("page_id", "has_marker", "module_scripts", "scripts", "has_root_id", "body_text_bytes",
                    S.spa_verdict().alias("spa"))


def q_spa_shell(spark, sf):
    return D.spa_html(_pages(spark, sf)).select("page_id", S.spa_shell(F.col("html")).alias("shell"))


def q_render_plan(spark, sf):
    return S.render_plan(_seeds(spark, sf), D.repeated_captures(D.mixed_captures(D.spa_html(_pages(spark, sf)))))


def q_manifest_record(spark, sf):
    return M.manifest_record(_mirror_plain(spark, sf))


def q_content_hash(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", TX.content_hash(F.col("text")).alias("hash"),
                       TX.byte_size(F.col("text")).alias("size"))


def _saved_run(spark, sf):
    """A run's entries and its mirror's files, both from one pass over the bodies."""
    from ..session import written
    from ..sources import mirror as MS
    from ..streaming.jobs import scratch_dir
    mirror = written(_mirror_plain(spark, sf))
    path = scratch_dir(spark, "mirror")
    MS.write_mirror(mirror, path)
    return M.manifest_record(mirror), MS.scan_mirror(spark, path)


def _found_later(files):
    """A mirror's files as a later run finds them: changed for seq % 7 = 0 and gone
    for seq % 11 = 0."""
    seq = F.col("seq")
    return (files.where(F.pmod(seq, F.lit(11)) != 0)
            .withColumn("content", F.when(F.pmod(seq, F.lit(7)) == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))))


def _entries(spark, sf):
    return M.manifest_record(_mirror_plain(spark, sf))


def _mirror_plain(spark, sf):
    from ..operators.rewrite import build_mirror
    return build_mirror(D.repeated_captures(_caps(spark, sf)))


def q_freshness(spark, sf):
    entries, files = _saved_run(spark, sf)
    return M.freshness(entries, _found_later(files)).select("site", "url", "path", "out_hash", "fresh")


def q_mirror_roundtrip(spark, sf):
    """A mirror just written is fresh, but for URLs that lost their path to a twin."""
    return M.freshness(*_saved_run(spark, sf)).select("site", "url", "path", "fresh")


def q_mirror_tree(spark, sf):
    """Entries of a run against the directory tree that the run before it wrote: the
    size of each file there, and whether it still is what the entry says."""
    from ..operators.rewrite import build_mirror
    from ..session import written
    from ..sources import mirror as MS
    from ..sources import mirror_tree as MT
    from ..streaming.jobs import scratch_dir
    root = scratch_dir(spark, "tree")
    MT.write_tree(MS.stored_files(written(build_mirror(_caps(spark, sf)))), root)
    entries = written(_entries(spark, sf))
    files = written(MT.tree_digests(entries, root))
    return M.freshness(entries, files).join(files, ["site", "path"], "left").select("site", "url", "path", "disk_size", "fresh")


def _stored_manifest(spark, sf, fmt, mirror=None):
    """Entries of the plain captures (or of a mirror at hand) written as a manifest."""
    from ..operators.rewrite import build_mirror
    from ..streaming.jobs import scratch_dir
    path = scratch_dir(spark, "manifest")
    M.write_manifest(M.manifest_record(build_mirror(_caps(spark, sf)) if mirror is None else mirror), path, fmt)
    return path


def q_write_manifest(spark, sf):
    """JSON lines, written and read back."""
    return M.read_manifest(spark, _stored_manifest(spark, sf, "json"), "json")


def q_read_manifest(spark, sf):
    """A stored manifest brought up to date by a later run, which saves the captures
    of the first and those that came again. A capture is rewritten once: what both
    runs say of the first ones is written without the bodies."""
    from ..operators.rewrite import build_mirror
    from ..session import written
    caps = _caps(spark, sf)
    first = written(build_mirror(caps).drop("content"))
    old = M.read_manifest(spark, _stored_manifest(spark, sf, "parquet", first))
    later = first.unionByName(build_mirror(D.repeats(caps)).drop("content"))
    return M.manifest_upsert(old, M.manifest_record(later))


def _two_rounds(spark, sf):
    """The manifest after a first run over all pages and a second one over those
    that were captured again. Its captures lie in two folders, one per run."""
    from ..operators.incremental import record_round
    from ..sources.manifest_store import ManifestStore
    from ..streaming.jobs import scratch_dir
    store = ManifestStore(spark, scratch_dir(spark, "store"))
    caps, seeds = D.repeated_captures(_caps(spark, sf)), _seeds(spark, sf)
    first = M.manifest_init(seeds, F.lit(1_700_000_000))
    record_round(store, 0, caps.where(F.col("seq") < 1_000_000_000), first)
    record_round(store, 1, caps.where(F.col("seq") >= 1_000_000_000), M.manifest_init(seeds, F.lit(1_800_000_000)))
    return store


def q_manifest_store(spark, sf):
    """The stored manifest after two runs: each site's entries, visited and found
    URLs, and its run."""
    store = _two_rounds(spark, sf)
    counts = [store.read(t).groupBy("site").agg(F.count("*").alias(t)) for t in ("entries", "visited", "found")]
    out = store.read("runs").select("site", "start_url", "created_at", "updated_at")
    for c in counts:
        out = out.join(c, "site", "left")
    hashes = store.read("entries").groupBy("site").agg(F.max("seq").alias("last_seq"), F.max("out_hash").alias("last_hash"))
    return out.join(hashes, "site", "left").select(
        "site", "start_url", "created_at", "updated_at", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("entries", "visited", "found")],
        "last_seq", "last_hash")


def q_incremental_rerun(spark, sf):
    """What a third run would fetch: decisions from the stored tables only."""
    from ..operators.incremental import next_round
    return next_round(_two_rounds(spark, sf), _rules(spark, sf)).select("site", "url", "decision")


def _crawl_rules(spark, sf):
    return RB.robots_rules(D.robots_texts(D.crawl_pages(_pages(spark, sf))))


def q_check_seeds(spark, sf):
    """Seeds as typed, and whether their site's robots rules allow them."""
    from ..operators.crawl import check_seeds
    return check_seeds(D.seed_inputs(_pages(spark, sf)), _rules(spark, sf)).select("seed_url", "ok", "site", "url", "allowed")


def q_crawl_rounds(spark, sf):
    """A crawl from each site's first page until nothing new is found: the round that
    asked for each URL, and whether it was saved."""
    from ..operators.crawl import crawl, crawl_log, recorded
    from ..sources.manifest_store import ManifestStore
    from ..streaming.jobs import scratch_dir
    pages = _pages(spark, sf)
    store = ManifestStore(spark, scratch_dir(spark, "crawl"))
    crawl(store, recorded(D.mixed_captures(D.crawl_pages(pages))), D.crawl_seeds(pages), _crawl_rules(spark, sf))
    saved = store.read("entries").select("site", "url", F.lit(True).alias("_saved"))
    return crawl_log(store).join(saved, ["site", "url"], "left").select("site", "url", "round", F.col("_saved").isNotNull().alias("saved"))


def _checked_captures(spark, sf):
    from ..sources.captures import load_captures_checked
    from ..streaming.jobs import scratch_dir
    path = scratch_dir(spark, "lines")
    D.capture_lines(_pages(spark, sf)).write.text(path)
    return load_captures_checked(spark, path)


def q_capture_errors(spark, sf):
    """Records of a capture file that cannot be used, each with its reason."""
    return _checked_captures(spark, sf)[1].select("site", "url", "seq", "status", "reason", "record")


def q_capture_totals(spark, sf):
    """Totals per site of a capture file: what was saved, and its bad records."""
    good, bad = _checked_captures(spark, sf)
    saved = url_dim(good, size=TX.byte_size(F.col("body")))
    return site_stats(saved.select("site", "rtype", "size"), errors=bad.where("site is not null").select("site"))


def q_manifest_lookup(spark, sf):
    urls = _links(spark, sf).select("site", F.col("dst_url").alias("url")).distinct()
    return M.manifest_lookup(urls, _entries(spark, sf))


def q_manifest_init(spark, sf):
    """Runs of all sites at one time, over those of an earlier time for some."""
    seeds = _seeds(spark, sf)
    old = M.manifest_init(seeds.where(F.pmod(F.length("site"), F.lit(2)) == 0), F.lit(1_700_000_000))
    return M.manifest_touch(old, M.manifest_init(seeds, F.lit(1_800_000_000)))


def _plan(spark, sf):
    """Decisions of a run, and the entries of the run before. Links are extracted
    once and written, as are the URLs found, which every join starts from."""
    from ..session import written
    links = written(X.extract_links(_caps(spark, sf), carry=("seq",)).select("site", "dst_url", "seq"))
    pages = _page_urls(spark, sf).select("site", "url")
    discovered = written(links.select("site", F.col("dst_url").alias("url")).unionByName(pages).distinct())
    entries, files = _saved_run(spark, sf)
    fresh = M.freshness(entries, _found_later(files))
    d_urls = discovered.select("site", "url", U.parsed("url")["path"].alias("path"))
    allowed = RB.robots_filter(d_urls, _rules(spark, sf))
    return M.plan_incremental(discovered, _old_visited(spark, sf, links), fresh, allowed), entries


def q_plan_incremental(spark, sf):
    return _plan(spark, sf)[0]


def q_skipped_stats(spark, sf):
    from ..session import written
    plan, entries = _plan(spark, sf)
    plan = written(plan)  # read twice
    fetched = plan.where("decision = 'fetch'").select("site", "url").join(
        entries.select("site", "url", "rtype", "size"), ["site", "url"])  # a URL counts once
    return site_stats(fetched.select("site", "rtype", "size"), skipped=M.skipped_stats(plan))


def q_seeds(spark, sf):
    from ..sources.captures import validate_seeds
    return validate_seeds(D.seed_inputs(_pages(spark, sf)))


def q_bundle(spark, sf):
    """Files and bytes of each site's bundle, counted in the bundle as written."""
    from ..session import written
    from ..sources.mirror import write_bundle
    from ..streaming.jobs import scratch_dir
    path = scratch_dir(spark, "bundle")
    write_bundle(written(_mirror_plain(spark, sf)), path)
    return spark.read.parquet(path).groupBy("site").agg(
        F.count("*").alias("files"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


def q_extract_css_refs(spark, sf):
    return X.extract_css_refs(D.css_captures(_pages(spark, sf)))


def q_rewrite_css(spark, sf):
    from ..operators.rewrite import build_mirror
    return build_mirror(D.css_captures(_pages(spark, sf))).select("url", "offline_path", "content")


def _rendered_pages(spark, sf):
    from ..operators.rewrite import rewrite_rendered
    return rewrite_rendered(D.rendered_from_pages(D.enriched_html(_pages(spark, sf))))


def q_rewrite_rendered(spark, sf):
    """Rendered pages as stored: scripts gone, links rewritten."""
    return M.manifest_record(_rendered_pages(spark, sf)).select("site", "url", "path", "size", "hash", "out_hash")


def q_rendered_frontier(spark, sf):
    """What a rendered run fetches next: requested assets without noise, and
    navigation links that are routes, each without what is in the manifest."""
    from ..operators.rendered import rendered_frontier
    rendered = D.rendered_from_pages(D.enriched_html(_pages(spark, sf)))
    return rendered_frontier(rendered, M.manifest_record(_rendered_pages(spark, sf)))


def q_extract_nav_links(spark, sf):
    return X.extract_nav_links(D.rendered_from_pages(_pages(spark, sf)))


def q_rendered_requests(spark, sf):
    return X.rendered_requests(D.rendered_from_pages(_pages(spark, sf)))


# ---------------------------------------------------------------------------
# Streaming forms (final state of a replay equals the batch result)
def _stream_source(spark, sf, captures=None):
    from ..streaming import jobs as SJ
    src = SJ.scratch_dir(spark, "captures")
    SJ.write_capture_rounds(_caps(spark, sf) if captures is None else captures, src)
    return src


def q_stream_visited(spark, sf):
    from ..streaming import jobs as SJ
    return SJ.stream_visited(spark, _stream_source(spark, sf), SJ.scratch_dir(spark, "visited"))


def q_stream_stats(spark, sf):
    from ..streaming import jobs as SJ
    captures = D.repeated_captures(_caps(spark, sf))
    return SJ.stream_stats(spark, _stream_source(spark, sf, captures), SJ.scratch_dir(spark, "stats"))


def q_stream_manifest(spark, sf):
    from ..streaming import jobs as SJ
    captures = D.repeated_captures(_caps(spark, sf))
    m = SJ.stream_manifest(spark, _stream_source(spark, sf, captures), SJ.scratch_dir(spark, "manifest"))
    return m.select("site", "url", "path", "size", "hash", "mtime", "rtype", "out_hash", "seq")


def q_stream_frontier(spark, sf):
    from ..streaming import jobs as SJ
    return SJ.stream_frontier(spark, _stream_source(spark, sf), _old_visited(spark, sf),
                              SJ.scratch_dir(spark, "frontier"))
