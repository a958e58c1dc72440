import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import oracle_duckdb as O
from mirrorline.functions.html import BREAKER_RULES

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["site", "pages", "resources", "bytes", "links", "distinct_targets"]


def test_every_query_of_the_library_has_an_oracle():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert not set(E.NAMES) - set(E.oracle_sql())


def test_oracle_imports_nothing_of_the_engine():
    with open(O.__file__) as f:
        assert "mirrorline" not in "".join(line for line in f if "import" in line)


def test_rewrite_is_map_only(spark):
    from mirrorline.operators.rewrite import build_mirror
    from mirrorline.sources.captures import captures_from_pages
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert "Exchange" not in _plan(build_mirror(captures_from_pages(pages)))


def test_robots_filter_has_no_nested_loop(spark):
    plan = _plan(E.queries()["robots_filter"](spark, SF))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def _duck():
    con = duckdb.connect()
    for t in ("pages", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _sorted_values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


# The slow, chained ones are compared by the driver and by tools/compare.py.
@pytest.mark.parametrize("name", [n for n in E.NAMES if n not in (
    "frontier", "visited_union", "plan_incremental", "skipped_stats", "freshness", "manifest_lookup", "read_manifest", "bundle",
    "stream_visited", "stream_frontier", "stream_manifest", "write_manifest", "manifest_record", "asset_dedupe", "rendered_frontier")])
def test_oracle_agrees_in_every_value(spark, name):
    df = E.queries()[name](spark, SF)
    rel = _duck().sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _sorted_values(df.columns, df.collect()) == _sorted_values(rel.columns, rel.fetchall())


def _differs(spark, name):
    df = E.queries()[name](spark, SF)
    rel = _duck().sql(E.oracle_sql()[name])
    return _sorted_values(df.columns, df.collect()) != _sorted_values(rel.columns, rel.fetchall())


def test_a_broken_pattern_turns_a_query_red(spark, monkeypatch):
    """Each fault alone makes values differ from the SQL, which agreed without it."""
    from mirrorline.functions import html as H
    faults = (("strip_offline_breakers", "ATTR_RE", H.ATTR_RE.replace("/=]++", "/=e]++", 1)), ("extract_links", "LINK_PAIRS", H.LINK_PAIRS[:3]))
    for query, name, broken in faults:
        assert broken != getattr(H, name) and not _differs(spark, query)
        with monkeypatch.context() as m:
            m.setattr(H, name, broken)
            assert _differs(spark, query), name


def test_every_branch_is_taken(spark):
    sf = "/root/testdata/sf0.01"
    outcomes = lambda name, col: {r[0] for r in E.queries()[name](spark, sf).select(col).distinct().collect()}
    assert outcomes("spa_shell", "shell") == {True, False} and outcomes("spa_features", "spa") == {True, False}
    assert outcomes("seeds", "reason") == {None, "invalid url", "scheme must be http or https", "missing or invalid host"}
    auto = E.queries()["render_plan"](spark, sf).where("lower(mode) not in ('on', 'yes', 'true', 'off', 'no', 'false')")
    assert {r[0] for r in auto.select("render").distinct().collect()} == {True, False}
    assert E.queries()["error_stats"](spark, sf).count() == 5
    totals = E.queries()["strip_offline_breakers"](spark, sf).agg(*[F.sum(r) for r in BREAKER_RULES]).first()
    assert all(totals)


def test_resolution_stands_once_in_the_plan(spark):
    """The pattern of an absolute URL, five times in one parse: for the page, the
    base and the link, not again in filters or projections."""
    from mirrorline.functions import urls as U
    plan = _plan(E.queries()["extract_links"](spark, SF))
    assert "Exchange" not in plan and plan.count(U._ABS_RE) == 15
