"""Rounds on the stored manifest, running totals, robots index, one row per site."""
import random

import pytest
from pyspark.sql import functions as F

from mirrorline.operators import robots as RB
from mirrorline.operators import spa as S
from mirrorline.operators.incremental import next_round, record_round
from mirrorline.operators.stats import site_stats
from mirrorline.operators.url_dim import url_dim
from mirrorline.functions import text as TX
from mirrorline.sources.captures import CAPTURES_SCHEMA
from mirrorline.sources.manifest_store import COMPACT_AFTER, SCHEMAS, ManifestStore
from mirrorline.streaming import jobs as SJ


def _entries(spark, *rows):
    return spark.createDataFrame([(s, u, "p", 1, "h", None, "page", f"o{q}", q) for s, u, q in rows], SCHEMAS["entries"])


def _urls(spark, *rows):
    return spark.createDataFrame(rows, SCHEMAS["visited"])


def _live(store):
    return sorted((r["url"], r["seq"]) for r in store.read("entries").collect())


def test_rounds_fold_and_replays_change_nothing(spark, tmp_path):
    store, want = ManifestStore(spark, str(tmp_path / "m")), {}
    for k in range(3 * COMPACT_AFTER):
        rows = [("s", f"u{k % 5}", k), ("s", f"v{k}", k)]
        want.update({u: q for _, u, q in rows})
        assert store.append(k, entries=_entries(spark, *rows), visited=_urls(spark, *[(s, u) for s, u, _ in rows]))
        assert not store.append(k, entries=_entries(spark, ("s", "replayed", 99)))  # also right after a fold
        assert len((store.last()["deltas"] or {}).get("entries", [])) < COMPACT_AFTER
    assert _live(store) == sorted(want.items())
    assert sorted(r["url"] for r in store.read("visited").collect()) == sorted(want)


def test_a_reader_sees_whole_versions_only(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path / "m"))
    store.append(0, entries=_entries(spark, ("s", "a", 1)))
    store._write(_entries(spark, ("s", "half", 2)), "entries")  # a run that died before its commit
    assert _live(store) == [("a", 1)]
    before = store._rows(store.last(), "entries")
    store.append(1, entries=_entries(spark, ("s", "a", 5)))
    assert [r["seq"] for r in before.collect()] == [1] and _live(store) == [("a", 5)]


def test_fresh_missing_and_bad(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path / "m"))
    assert store.read("runs").count() == 0
    store.write(entries=_entries(spark, ("s", "a", 1)), visited=_urls(spark, ("s", "a")))
    assert store.read("found").count() == 0 and _live(store) == [("a", 1)]
    fresh = ManifestStore(spark, store.path, fresh=True)
    assert fresh.read("entries").count() == 0
    folder = tmp_path / "m" / store.last()["bases"]["entries"]
    for f in folder.glob("*.parquet"):
        f.unlink()
    for f in folder.iterdir():
        f.unlink()
    folder.rmdir()
    with pytest.warns(UserWarning, match="entries of the manifest"):
        assert store.read("entries").count() == 0
    assert store.read("visited").count() == 1
    commit = next((tmp_path / "m" / "commits").glob("part-*.json"))
    commit.write_text("no json")
    for f in (tmp_path / "m" / "commits").glob(".part-*.crc"):
        f.unlink()
    with pytest.warns(UserWarning, match="not used"):
        assert store.read("visited").count() == 0


def _caps(spark, *rows):
    return spark.createDataFrame([(u, st, "text/html", None, b, q) for u, st, b, q in rows], CAPTURES_SCHEMA)


def test_a_second_run_reads_no_old_body(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path / "m"))
    for k, rows in enumerate(([("http://s/a", 200, "<a href=/b><a href=/no/x>", 1), ("http://s/gone", 404, "", 2)], [("http://s/b", 200, "<a href=/c>", 3)])):
        _caps(spark, *rows).write.parquet(str(tmp_path / f"captures-{k}"))
        assert record_round(store, k, spark.read.schema(CAPTURES_SCHEMA).parquet(str(tmp_path / f"captures-{k}")))
    rules = spark.createDataFrame([("s", False, "/no/")], "site string, allow boolean, prefix string")
    plan = next_round(store, rules)
    assert {(r["url"], r["decision"]) for r in plan.collect()} == {
        ("http://s/a", "visited"), ("http://s/b", "visited"), ("http://s/gone", "visited"), ("http://s/no/x", "robots"), ("http://s/c", "fetch")}
    assert plan.inputFiles() and not any("captures-" in f for f in plan.inputFiles())


def test_running_totals_take_back_earlier_captures(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(f"http://{'www.' if k % 3 else ''}s{k % 4}/p{rnd.randrange(12)}", 200, rnd.choice(["text/html", "text/css", "image/png"]), None, "x" * rnd.randrange(50), k) for k in range(90)]
    rnd.shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k::5], CAPTURES_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "src" / f"r{k}"))
    got = SJ.stream_stats(spark, str(tmp_path / "src"), str(tmp_path / "sink"))
    caps = spark.createDataFrame(rows, CAPTURES_SCHEMA)
    want = site_stats(url_dim(caps, size=TX.byte_size(F.col("body"))).select("site", "rtype", "size"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_robots_index_equals_a_scan_of_the_rules(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choices("ab/é", k=rnd.randint(0, n)))
    rules = [(f"s{rnd.randrange(3)}", rnd.random() < .5, "/" + word(4)) for _ in range(80)]
    urls = [(f"s{rnd.randrange(4)}", f"u{k}", None if k % 50 == 7 else "/" + word(7)) for k in range(400)]

    def plain(site, path):
        own = [(len(p.encode()), a) for s, a, p in rules if s == site and path is not None and path.startswith(p)]
        return max(own)[1] if own else True
    got = RB.robots_filter(spark.createDataFrame(urls, "site string, url string, path string"), spark.createDataFrame(rules, "site string, allow boolean, prefix string"))
    assert got.columns == ["site", "url", "path", "allowed"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((s, u, p, plain(s, p)) for s, u, p in urls), key=str)


def test_robots_index_with_many_rules_and_urls(spark):
    rules = spark.range(50_000).select(F.concat(F.lit("s"), (F.col("id") % 1).cast("string")).alias("site"), (F.col("id") % 2 == 0).alias("allow"), F.concat(F.lit("/d"), F.col("id").cast("string"), F.lit("/")).alias("prefix"))
    urls = spark.range(300_000).select(F.concat(F.lit("s"), (F.col("id") % 1).cast("string")).alias("site"), F.col("id").cast("string").alias("url"), F.concat(F.lit("/d"), (F.col("id") % 60_000).cast("string"), F.lit("/x")).alias("path"))
    got = RB.robots_filter(urls, rules)
    assert got.where(~F.col("allowed")).count() == 125_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_seed_captured_twice_gives_one_row(spark):
    shell = '<div data-reactroot></div>'
    seeds = spark.createDataFrame([("s", "http://s/", "auto"), ("t", "http://t/", "auto")], "site string, seed_url string, mode string")
    plan = S.render_plan(seeds, _caps(spark, ("http://s/", 200, shell, 1), ("http://s/#x", 200, "plain", 2), ("http://t/", 200, "plain", 4), ("http://t/", 404, shell, 5), ("http://t/", 200, shell, 3)))
    assert sorted((r["site"], r["render"]) for r in plan.collect()) == [("s", False), ("t", False)]
