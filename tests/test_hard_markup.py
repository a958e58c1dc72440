"""Pages that must not break a job: very long and broken markup, odd references."""
import pytest
from pyspark.sql import functions as F

from mirrorline.functions import html as H
from mirrorline.functions import urls as U
from mirrorline.operators.extract import extract_links

CAPTURE = "url string, status int, content_type string, last_modified string, body string, seq bigint"


def _links(spark, *bodies):
    rows = [(f"https://example.com/p{i}", 200, "text/html", None, b, i) for i, b in enumerate(bodies)]
    return sorted((r.src_url, r.dst_url) for r in extract_links(spark.createDataFrame(rows, CAPTURE)).collect())


def test_long_and_broken_tags(spark):
    long = "x" * 200_000
    got = _links(spark, f"<a href=/{long}>t</a>", "<p>a <a " + "y" * 20_000 + "<b>z</b><a href='/ok'>", "<a " * 20_000, "<img src=\"" + long,
                 "<a" + " " * 100_000 + "href=/spaced>", f"<a {'b=c ' * 20_000} href=/last>")
    assert got == [("https://example.com/p0", "https://example.com/" + long), ("https://example.com/p1", "https://example.com/ok"),
                   ("https://example.com/p4", "https://example.com/spaced"), ("https://example.com/p5", "https://example.com/last")]


@pytest.mark.parametrize("value, attribute, text", [
    ("a&#x110000;b", "a�b", None), ("&#xD800;", "�", None), ("&#0;", "�", None), ("&#0000000038;", "&", None), ("&#x0000000026", "&", None),
    ("&#x80;&#150;", "€–", None), ("&eacute;", "é", None), ("x&amp", "x&", None), ("&ampb", "&ampb", "&b"), ("?a=1&copy=2", "?a=1&copy=2", "?a=1©=2"),
    ("&amp;lt;", "&lt;", None), ("&unknown;&", "&unknown;&", None), ("&NotEqualTilde;", "≂̸", None), ("&#;&#x;", "&#;&#x;", None), ("&#99999999999;", "�", None)])
def test_character_references(spark, value, attribute, text):
    df = spark.createDataFrame([(value,)], "v string")
    row = df.select(H.decode_entities(F.col("v")).alias("a"), H.decode_entities(F.col("v"), in_text=True).alias("t")).first()
    assert (row.a, row.t) == (attribute, attribute if text is None else text)


def test_ports_with_leading_zeros(spark):
    urls = ["http://a.b:000080/x", "http://a.b:0008080/x", "http://a.b:99999/x", "http://a.b:0/x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(U.normalize_url(F.col("u"))).collect()] == ["http://a.b/x", "http://a.b:8080/x", None, "http://a.b:0/x"]


def test_breakers_by_rule(spark):
    doc = ('<LINK rel=manifest href=/m.json><link href="/m.js" rel="modulepreload"><link rel="preload" as="style" href="/s.css"><link as=script rel=preload>'
           '<script src="/js/workbox-1.js">\n</script><script src="/sw.js">own()</script><script>navigator.serviceWorker.register("/x")</script>'
           '<p>crossorigin stays crossorigin="in text"</p><img crossorigin=anonymous src=x><img src=y crossorigin><script crossorigin>ok()</script>')
    row = spark.createDataFrame([(doc,)], "h string").select(H.without_breakers(F.col("h")).alias("r")).first().r
    assert row.removed == ["manifest_link", "modulepreload_link", "script_preload_link", "sw_script", "sw_inline_script"]
    assert row.html == ('<link rel="preload" as="style" href="/s.css"><script src="/sw.js">own()</script>'
                        '<p>crossorigin stays crossorigin="in text"</p><img src=x><img src=y><script>ok()</script>')


def test_breakers_on_long_input(spark):
    doc = "<script " + "a=b " * 50_000 + ">" + "x<" * 50_000 + "</script>" + "<link " * 2_000
    row = spark.createDataFrame([(doc,)], "h string").select(H.without_breakers(F.col("h")).alias("r")).first().r
    assert row.html == doc and row.removed == []


HOSTILE = ["<script>", "<a ", "<base ", "url(", "<script ", "<style>", "<body ", "<head>", "<head ", "<!--", "<link ", "<base href=", "<a href='", '<a href="', " ",
           "@import ", "</script ", "<a id=", "url('", "<script>x</script ", " crossorigin", "<textarea>", "\n\t ", " href=", "&", "<", "url(a'"]


def _scans():
    from mirrorline.operators import spa
    from mirrorline.operators.rewrite import rewrite_css, rewrite_html
    h = F.col("body")

    def staged(f):
        return lambda df: df.select("body", U.parsed("url").alias("u"), U.hosts_in("body").alias("hosts")).select(f(h, F.col("u"), F.col("hosts")))
    features = [F.col(c) for c in ("has_root_id", "body_text_bytes", "scripts")]
    return {"strip_scripts": lambda df: df.select(H.strip_scripts(h)), "without_breakers": lambda df: df.select(H.without_breakers(h)),
            "visible_text": lambda df: df.select(H.visible_text(h)), "rewrite_html": staged(rewrite_html),
            "rewrite_css": staged(rewrite_css), "spa_features": lambda df: spa.spa_features(df, "body").select(*features),
            "extract_links": extract_links}


@pytest.mark.parametrize("name", ["extract_links", "rewrite_css", "rewrite_html", "spa_features", "strip_scripts", "visible_text", "without_breakers"])
def test_a_megabyte_of_one_sign_take_linear_time(spark, name):
    """All hostile documents, 1 MB each, one after the other: under 1 s a document
    (a quadratic scan of one of them takes many minutes)."""
    import time
    run = _scans()[name]

    def seconds(size):
        rows = [("https://example.com/a/b", 200, "text/html", None, "<p class=x>" + u * (size // len(u)) + "x", 1) for u in HOSTILE]
        df = spark.createDataFrame(rows, CAPTURE).coalesce(1)
        began = time.time()
        run(df).write.format("noop").mode("overwrite").save()
        return time.time() - began
    small = seconds(20)
    assert seconds(1_000_000) - small < len(HOSTILE)


def test_what_does_not_end_is_left_as_it_is(spark):
    df = spark.createDataFrame([(d,) for d in (
        "a<script>b</script>c<script>d", "a<script b", "<scripts>x</script>y", "<script><script></script></script>", "<SCRIPT x>1</Script>2</script>")], "h string")
    assert [r[0] for r in df.select(H.strip_scripts(F.col("h"))).collect()] == ["ac<script>d", "a<script b", "y", "</script>", "2</script>"]
    df = spark.createDataFrame([(d,) for d in (
        '<link rel=manifest><script>serviceWorker', '<link x="><link rel=manifest>', "<link rel=manifest><a crossorigin><b crossorigin=' x>", "<links rel=manifest>")], "h string")
    assert [r[0] for r in df.select(H.strip_offline_breakers(F.col("h"))).collect()] == [
        "<script>serviceWorker", '<link x="><link rel=manifest>', "<a><b crossorigin=' x>", "<links rel=manifest>"]


def test_stylesheet_targets(spark):
    from mirrorline.operators.rewrite import rewrite_css
    sheets = ["url(/a.png) url( '/b.png' ) url(\"/c d.png\")", "url(/a url(/b) x", "url('/a\"b') url(/c)", "url(/never ends", "url( )x@import '/i.css'", "url() @import \"/a", "url(/x'y url(/z)"]
    df = spark.createDataFrame([(c, "https://example.com/s/t.css") for c in sheets], "c string, u string")
    df = df.select("c", U.parsed("u").alias("u"), U.hosts_in("c").alias("hosts"))
    got = [r[0] for r in df.select(rewrite_css(F.col("c"), F.col("u"), F.col("hosts"))).collect()]
    assert got == ['url("../a.png") url("../b.png") url("../c%20d.png")', 'url("../a%20url(/b/index.html") x', "url('/a\"b') url(\"../c\")".replace("../c", "../c/index.html"),
                   "url(/never ends", 'url("t.css")x@import url("../i.css")', 'url() @import "/a', "url(/x'y url(/z)"]
