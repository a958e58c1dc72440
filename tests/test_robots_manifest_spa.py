import hashlib

import pytest
from pyspark.sql import functions as F

from mirrorline.operators import fetchlog as FL
from mirrorline.operators import manifest as M
from mirrorline.operators import robots as RB
from mirrorline.operators import spa as S
from mirrorline.operators.extract import extract_links
from mirrorline.operators.rewrite import build_mirror
from mirrorline.operators.stats import site_stats
from mirrorline.operators.url_dim import url_dim
from mirrorline.sources import mirror as MS
from mirrorline.sources.captures import load_captures, text_bodies


def _allowed(spark, rules, paths):
    r = spark.createDataFrame([("s", a, p) for a, p in rules] or [("z", True, "/")], "site string, allow boolean, prefix string")
    u = spark.createDataFrame([("s", p, p) for p in paths], "site string, url string, path string")
    return {x.path: x.allowed for x in RB.robots_filter(u, r).collect()}


def test_robots_vectors(spark):
    assert _allowed(spark, [], ["/anything"]) == {"/anything": True}
    assert _allowed(spark, [(False, "/private")], ["/private/secret", "/public"]) == {
        "/private/secret": False, "/public": True}
    assert _allowed(spark, [(False, "/private"), (True, "/private/public")],
                    ["/private/public/page", "/private/secret"]) == {
        "/private/public/page": True, "/private/secret": False}
    assert _allowed(spark, [(False, "/path"), (True, "/path")], ["/path/page"]) == {"/path/page": True}


def test_robots_parse(spark):
    body = ("# c\nUser-agent: a\nUser-agent: *\nDisallow: /x\nDisallow:\nuser-agent: b\nAllow: /y\n"
            "User-agent: bot\nDisallow: /z\n")
    df = spark.createDataFrame([("s", body)], "site string, body string")
    rules = [(r.allow, r.prefix) for r in RB.robots_rules(df).orderBy("line").collect()]
    assert rules == [(False, "/x"), (True, "/y")]


CAPTURE = "url string, status int, content_type string, last_modified string, body string, seq bigint"


def test_incremental_chain(spark, tmp_path):
    """A mirror just written is fresh; the later capture wins, per URL and per file."""
    rows = [("https://a.b/", 200, "text/html", None, '<a href="/x">1</a>', 1), ("https://a.b/", 200, "text/html", None, '<a href="/x">2</a>', 5),
            ("http://www.a.b/", 200, "text/html", None, "twin", 3), ("https://a.b/i.png", 200, "image/png", None, "png", 2)]
    mirror = build_mirror(spark.createDataFrame(rows, CAPTURE))
    entries = M.manifest_record(mirror)
    assert {(r.url, r.seq) for r in entries.collect()} == {("https://a.b/", 5), ("http://www.a.b/", 3), ("https://a.b/i.png", 2)}
    MS.write_mirror(mirror, str(tmp_path / "m"))
    files = MS.scan_mirror(spark, str(tmp_path / "m"))
    assert sorted((r.path, r.seq) for r in files.collect()) == [("i.png", 2), ("index.html", 5)]
    fresh = M.freshness(entries, files).collect()
    assert {r.url: r.fresh for r in fresh} == {"https://a.b/": True, "http://www.a.b/": False, "https://a.b/i.png": True} and len(fresh) == 3
    changed = files.withColumn("content", F.when(F.col("path") == "i.png", "other").otherwise(F.col("content")))
    assert not any(r.fresh for r in M.freshness(entries, changed).collect() if r.path == "i.png")
    assert not any(r.fresh for r in M.freshness(entries, files.limit(0)).collect())
    assert MS.bundle_totals(mirror).collect()[0].files == 2
    plan = M.plan_incremental(entries.select("site", "url"), entries.limit(0), M.freshness(entries, files), None).collect()
    assert {r.url: r.decision for r in plan} == {"https://a.b/": "fresh", "http://www.a.b/": "fetch", "https://a.b/i.png": "fresh"} and len(plan) == 3


def test_manifest_files(spark, tmp_path):
    rows = [("https://a.b/", 200, "text/html", None, "x", 1), ("https://c.d/p", 200, "text/html", "Mon, 01 Jan 2024 00:00:00 GMT", "y", 2)]
    entries = M.manifest_record(build_mirror(spark.createDataFrame(rows, CAPTURE)))
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        M.write_manifest(entries, path, fmt)
        assert sorted(M.read_manifest(spark, path, fmt).collect()) == sorted(entries.collect())
        assert M.read_manifest(spark, path, fmt, fresh=True).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "m.json").write_text('{"site": "a.b", "url": \n nonsense')
    for path, fmt in ((tmp_path / "bad", "json"), (tmp_path / "none", "json"), (tmp_path / "none", "parquet")):
        with pytest.warns(UserWarning, match="not used"):
            assert M.read_manifest(spark, str(path), fmt).count() == 0
    newer = entries.where("site = 'a.b'").withColumn("seq", F.lit(9).cast("bigint")).withColumn("size", F.lit(7).cast("bigint"))
    assert {(r.site, r.size) for r in M.manifest_upsert(entries, newer).collect()} == {("a.b", 7), ("c.d", 1)}


def test_runs_keep_their_start_and_move_their_update(spark):
    seeds = spark.createDataFrame([("a.b", "https://a.b/"), ("c.d", "https://c.d/")], "site string, seed_url string")
    old = M.manifest_init(seeds.limit(1).withColumn("seed_url", F.lit("https://a.b/old")), F.lit(10))
    got = {r.site: (r.start_url, r.created_at, r.updated_at) for r in M.manifest_touch(old, M.manifest_init(seeds, F.lit(20))).collect()}
    assert got == {"a.b": ("https://a.b/old", "10", "20"), "c.d": ("https://c.d/", "20", "20")}


def test_binary_bodies(spark):
    rows = [("https://a.b/i.png", 200, "image/png", None, b"\x89PNG\xff\x00", 1), ("https://a.b/", 200, "text/html", None, b"<a href=\"/x\">\xff</a>", 2)]
    got = {r.url: r for r in build_mirror(spark.createDataFrame(rows, CAPTURE.replace("body string", "body binary"))).collect()}
    png = got["https://a.b/i.png"]
    assert bytes(png.content) == rows[0][4] and png.size == 6 and png.hash == png.out_hash == "sha256:" + hashlib.sha256(rows[0][4]).hexdigest()
    assert bytes(got["https://a.b/"].content).decode() == '<a href="x/index.html">\ufffd</a>'


def test_binary_captures_are_read_and_extracted(spark, tmp_path):
    rows = [("https://a.b/", 200, "text/html", None, b"\xff<a href=\"/x\">", 2)]
    spark.createDataFrame(rows, CAPTURE.replace("body string", "body binary")).write.parquet(str(tmp_path / "c"))
    caps = load_captures(spark, str(tmp_path / "c"), binary=True)
    assert dict(caps.dtypes)["body"] == "binary"
    assert [r.dst_url for r in extract_links(text_bodies(caps)).collect()] == ["https://a.b/x"]


def test_site_stats_counts_a_url_once(spark):
    rows = [("https://a.b/", 200, "text/html", None, "12345", 1), ("https://a.b/#f", 200, "text/html", None, "123", 2)]
    caps = spark.createDataFrame(rows, CAPTURE)
    got = site_stats(url_dim(caps, size=F.octet_length("body")).select("site", "rtype", "size")).first()
    assert (got.pages, got.total_bytes) == (1, 3)


def test_spa_shell_vectors(spark):
    def page(mount, script, text):
        return f"<html><head></head><body>{mount}{script}<div>{text}</div></body></html>"
    rows = [page('<section id="app"></section>', "<script>go()</script>", ""), page("<div id='root'> </div>", '<script src="m.js"></script>', "short"),
            page('<div id="app"></div>', '<script src="m.js"></script>', "served words " * 20), page('<div id="app"></div>', "", ""), page("", "<script></script>", "")]
    df = spark.createDataFrame([(r,) for r in rows], "h string")
    assert [r[0] for r in df.select(S.spa_shell(F.col("h"))).collect()] == [True, True, False, False, False]


def test_body_text_counts_script_text_whole(spark):
    loop = "for(i=0;i<n;i++){a[i]='<b>'}"
    rows = [f"<body><script>{loop}</script> x&amp;y<i>z</i></body>", "<body><!-- no --><p>&eacute;</p></body>", "<head><title>t</title></head>ab", "<body><style>a>b{}</style>"]
    df = spark.createDataFrame([(r,) for r in rows], "h string")
    assert [r[0] for r in df.select(S.body_text_bytes(F.col("h"))).collect()] == [len(loop) + 5, 2, 2, 5]


def test_spa_verdict_thresholds(spark):
    def page(text_len, root=True, modules=1, scripts=1):
        s = "".join('<script type="module" src="/m.js"></script>' for _ in range(modules))
        s += "".join("<script src='/x.js'></script>" for _ in range(max(0, scripts - modules)))
        rid = '<div id="root"></div>' if root else "<div></div>"
        return f"<html><head>{s}</head><body>{rid}{'x' * text_len}</body></html>"
    rows = [(page(499),), (page(500),), (page(199, root=False, scripts=3),), (page(200, root=False, scripts=3),),
            ("<div data-reactroot></div>",)]
    df = spark.createDataFrame(rows, "html string")
    got = [r[0] for r in S.spa_features(df).select(S.spa_verdict()).collect()]
    assert got == [True, False, True, False, True]


def test_fetch_outcomes(spark):
    rows = [("a", 0, 200), ("b", 0, 503), ("b", 1, 200), ("c", 0, 503), ("c", 1, 503), ("c", 2, 503),
            ("d", 0, 404), ("e", 0, None), ("e", 1, 429), ("e", 2, 200), ("f", 0, 503), ("f", 1, 503)]
    df = spark.createDataFrame(rows, "url string, attempt int, status int")
    got = {r.url: (r.outcome, r.attempts, r.backoff_ms) for r in FL.fetch_outcomes(df).collect()}
    assert got == {"a": ("ok", 1, 0), "b": ("ok", 2, 500), "c": ("exhausted", 3, 1500), "d": ("failed", 1, 0),
                   "e": ("ok", 3, 1500), "f": ("pending", 2, 500)}
