"""Work that is done once: per row, per run and per round."""

from pyspark.sql import functions as F

from mirrorline.functions import html as H
from mirrorline.functions import urls as U
from mirrorline.operators import crawl as C
from mirrorline.operators.extract import extract_links
from mirrorline.operators.rewrite import ATTR_REWRITE_RE, build_mirror
from mirrorline.plans import queries as Q
from mirrorline.sources.captures import CAPTURES_SCHEMA
from mirrorline.sources.manifest_store import ManifestStore
from mirrorline.streaming import jobs as SJ


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _captures(spark, n):
    return spark.createDataFrame([(f"https://a.test/{k % 5}", 200, "text/html", None, f'<a href="/{k}">x</a>', k) for k in range(n)], CAPTURES_SCHEMA)


def _pages(spark, path):
    rows = [(k, f"https://a.test/en/{k}", f'<a href="/en/{k + 1}">x</a><a href="/gone">y</a>') for k in range(14)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_batches_follow_bytes_not_files(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    captures = _captures(spark, 24)
    for k in range(6):
        captures.where(F.col("seq") % 6 == k).coalesce(1).write.parquet(f"{source}/round-{k}")
    got = SJ.stream_manifest(spark, source, sink).select("url", "seq").collect()
    assert sorted(map(tuple, got)) == [(f"https://a.test/{k}", 20 + k if k < 4 else 19) for k in range(5)]
    assert ManifestStore(spark, sink).last()["round_id"] == 0


def test_a_page_is_parsed_and_scanned_once(spark):
    captures = _captures(spark, 3)
    assert _plan(build_mirror(captures).select("site", "url")).count(U._ABS_RE) == 5
    assert _plan(extract_links(captures)).count(H.BLANK_RE) == 1


def test_attributes_begin_at_any_white_space(spark):
    plain = rf"(?i)(?<![{U.WS}])[{U.WS}]++(href|src|action|poster|srcset)[{U.WS}]*+=[{U.WS}]*+\"([^\"]*+)\""
    text = "".join(f'{a}{b}{n}{c}="v" x{a}y' for a in ("", " ", "\t\n", " ", "　  ", "\U0001f600", "-", "é")
                   for b in ("", " ", "\x85") for n in ("href", "SRCset", "src", "Action", "poster", "data-src", "ahref") for c in ("", " "))
    row = spark.createDataFrame([(text,)], "t string").select(
        *[F.regexp_extract_all("t", F.lit(p), 0).alias(n) for n, p in (("new", ATTR_REWRITE_RE), ("old", plain))]).first()
    assert row["new"] == row["old"] and len(row["new"]) > 100


def test_decisions_are_made_from_written_links(spark, tmp_path):
    sf = _pages(spark, tmp_path)
    plan = Q.q_plan_incremental(spark, sf)
    assert H.BLANK_RE not in _plan(plan)
    found = {r["url"]: r["decision"] for r in plan.collect()}
    assert len(found) == 16 and found["https://a.test/gone"] == "visited" and found["https://a.test/en/9"] == "visited"


def test_a_round_parses_no_recorded_address(spark):
    fetch = C.recorded(_captures(spark, 10))
    asked = spark.createDataFrame([("a.test", "https://a.test/1")], "site string, url string")
    got = fetch(asked)
    assert U._ABS_RE not in _plan(got) and sorted(r["seq"] for r in got.collect()) == [1, 6]


def test_a_later_run_rewrites_what_came_again_only(spark, tmp_path):
    sf = _pages(spark, tmp_path)
    scan = "FileScan parquet [page_id"
    assert _plan(Q._entries(spark, sf)).count(scan) == 3  # the captures, those that came again, their twins
    assert _plan(Q.q_read_manifest(spark, sf)).count(scan) == 2
