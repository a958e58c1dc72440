"""The crawl loop: order of rounds, seeds and robots, going on after a stop; bad records."""
import json

import pytest

from mirrorline.operators import crawl as C
from mirrorline.operators import incremental
from mirrorline.operators.fetchlog import error_stats
from mirrorline.sources.captures import CAPTURES_SCHEMA, load_captures_checked
from mirrorline.sources.manifest_store import ManifestStore

WEB = {"http://s/": (200, "<a href=/a><a href=/no/b><a href=/gone>"), "http://s/a": (200, "<a href=/><a href=/c#x><a href=http://t/>"),
       "http://s/c": (200, "<a href=/d>"), "http://s/d": (404, "<a href=/e>"), "http://s/no/b": (200, "<a href=/f>"), "http://s/f": (200, "")}


@pytest.fixture
def web(spark):
    rows = [(u, st, "text/html", None, b, k) for k, (u, (st, b)) in enumerate(WEB.items())]
    seeds = spark.createDataFrame([("s", "http://s/"), ("s", "http://s/no/seed"), (None, "ftp://s/")], "site string, seed_url string")
    rules = spark.createDataFrame([("s", False, "/no/")], "site string, allow boolean, prefix string")
    return C.recorded(spark.createDataFrame(rows, CAPTURES_SCHEMA)), seeds, rules


def _log(store):
    return {(r["url"], r["round"]) for r in C.crawl_log(store).collect()}


SEEDS = {("http://s/", 0), ("http://s/no/seed", 0)}
REST = {("http://s/a", 1), ("http://s/gone", 1), ("http://s/c", 2), ("http://s/d", 3)}


def test_rounds_until_nothing_is_new_and_going_on_after_a_stop(spark, tmp_path, web, monkeypatch):
    fetch, seeds, rules = web
    store = ManifestStore(spark, str(tmp_path / "m"))
    assert C.crawl_log(store).count() == 0
    assert C.crawl(store, fetch, seeds, rules, max_rounds=1) == 1 and _log(store) == SEEDS

    def dies(*args, **kwargs):
        raise RuntimeError("lost")
    monkeypatch.setattr(incremental.ManifestStore, "append", dies)  # after the answers were kept
    with pytest.raises(RuntimeError):
        C.crawl(store, fetch, seeds, rules)
    assert _log(store) == SEEDS  # a round that is not committed does not count
    monkeypatch.undo()
    again = ManifestStore(spark, str(tmp_path / "m"))
    assert C.crawl(again, fetch, seeds, rules) == 3 and _log(again) == SEEDS | REST
    assert {r["url"] for r in again.read("entries").collect()} == {"http://s/", "http://s/a", "http://s/c"}
    assert {(r["url"]) for r in again.read("visited").collect()} == {u for u, _ in SEEDS | REST}
    assert C.crawl(again, fetch, seeds, rules) == 0


def test_seeds_are_checked_only_if_asked(spark, web):
    _, seeds, rules = web
    got = {r["seed_url"]: (r["ok"], r["url"], r["allowed"]) for r in C.check_seeds(seeds.select("seed_url"), rules).collect()}
    assert got == {"http://s/": (True, "http://s/", True), "http://s/no/seed": (True, "http://s/no/seed", False), "ftp://s/": (False, None, None)}


def test_a_denied_seed_is_left_out(spark, tmp_path, web):
    fetch, seeds, rules = web
    store = ManifestStore(spark, str(tmp_path / "m"))
    C.crawl(store, fetch, seeds, rules, check_seed=True, max_rounds=1)
    assert _log(store) == {("http://s/", 0)}


def test_every_record_is_used_or_an_error(spark, tmp_path):
    ok = {"url": "http://www.s/a", "status": 200, "content_type": "text/html", "body": "<p>é</p>", "seq": 1}
    bad = {"status 404": ok | {"status": 404}, "no response": ok | {"status": None}, "missing url": ok | {"url": " "},
           "invalid url": ok | {"url": "a b"}, "missing seq": {k: v for k, v in ok.items() if k != "seq"}}
    broken = ['{"url":"http://s/x","status":', json.dumps(ok | {"status": "soon"}), json.dumps(ok | {"seq": [1]}), "<html>"]
    (tmp_path / "c.json").write_text("\n".join([json.dumps(ok), *map(json.dumps, bad.values()), *broken]) + "\n")
    good, errors = load_captures_checked(spark, str(tmp_path))
    assert [(r["url"], r["status"], r["body"], r["seq"]) for r in good.collect()] == [("http://www.s/a", 200, "<p>é</p>", 1)]
    assert good.select("url").count() == 1  # also where other columns are pruned
    got = errors.collect()
    assert sorted(r["reason"] for r in got) == sorted([*bad, *["malformed record"] * 4])
    assert sorted(r["record"] for r in got if r["record"]) == sorted(broken)
    assert all(r["url"] is None and r["site"] is None for r in got if r["record"])
    assert {r["site"]: r["errors"] for r in error_stats(errors).collect()} == {None: 6, "s": 3}
