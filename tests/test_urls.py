from pyspark.sql import functions as F

from mirrorline.functions import text as TX
from mirrorline.functions import urls as U


def _one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_offline_path_vectors(spark):
    urls = ["https://example.com/article?id=1", "https://example.com/img/photo.png?v=2",
            "https://example.com/post?id=1", "https://example.com/post?id=2", "https://example.com/about",
            "https://example.com/images/logo.png", "https://example.com/", "https://example.com/a/?q=1",
            "https://example.com/a.tar.gz?v=1", "https://example.com/x?", "https://example.com/x?a/b:c*d|e"]
    u = U.parse_absolute(F.col("u"))
    out = _one(spark, [(x,) for x in urls], "u string", U.offline_path(u["path"], u["query"]))
    assert out == ["article@id=1/index.html", "img/photo@v=2.png", "post@id=1/index.html",
                   "post@id=2/index.html", "about/index.html", "images/logo.png", "index.html",
                   "a/@q=1/index.html", "a.tar@v=1.gz", "x/index.html", "x@a_b_c_d_e/index.html"]


def test_relative_link_vectors(spark):
    rows = [("index.html", "images/logo.png"), ("about/index.html", "index.html"), ("a/b/index.html", "a/b/index.html"),
            ("index.html", "index.html")]
    out = _one(spark, rows, "p string, t string", U.relative_link(F.col("p"), F.col("t")))
    assert out == ["images/logo.png", "../index.html", "index.html", "index.html"]


def test_resolve_and_normalize(spark):
    rows = [("https://example.com/a/b/c", "../d/./e?x=1#f"), ("https://example.com/a/b/c", "für bar"),
            ("https://example.com/a/b/c", "//WWW.Example.com:443/x/.."), ("https://example.com/a", "mailto:x@y"),
            ("http://example.com/a", "https:zz"), ("https://example.com/a?o=1", "")]
    b = U.parse_absolute(F.col("b"))
    out = _one(spark, rows, "b string, r string", U.serialize(U.resolve(b, F.col("r"))))
    assert out == ["https://example.com/a/d/e?x=1", "https://example.com/a/b/f%C3%BCr%20bar",
                   "https://www.example.com/", None, "https://zz/", "https://example.com/a?o=1"]


def test_classify(spark):
    rows = [("text/html; charset=utf-8", "/x.png"), ("TEXT/HTML", "/x.png"), ("image/svg+xml", "/a"),
            ("font/woff2", "/a.html"), ("application/json", "/api/items"), (None, "/a.css"), (None, "/a.mjs"),
            (None, "/a.JPEG"), (None, "/a.bin"), (None, "/dir/"), ("application/x-font-woff", "/f.woff")]
    out = _one(spark, rows, "ct string, p string", U.classify_resource(F.col("ct"), F.col("p")))
    assert out == ["page", "image", "image", "other", "page", "css", "js", "image", "other", "page", "other"]


def test_format_bytes(spark):
    vals = [0, 1023, 1024, 1025, 1048576, 1048577, 5 * 1024 ** 4]
    out = _one(spark, [(v,) for v in vals], "n long", TX.format_bytes(F.col("n")))
    assert out == ["0 B", "1023 B", "1024 B", "1.0 KB", "1024.0 KB", "1.0 MB", "5120.0 GB"]


def test_content_hash(spark):
    out = _one(spark, [("hello world",)], "s string", TX.content_hash(F.col("s")))
    assert out[0].startswith("sha256:") and len(out[0]) == 71
    assert out[0] == "sha256:b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"


def test_same_site(spark):
    rows = [("www.example.com", "example.com"), ("m.example.com", "example.com"), ("example.com", "www.example.com")]
    assert _one(spark, rows, "a string, b string", U.same_site(F.col("a"), F.col("b"))) == [True, False, True]


def test_punycode_equals_the_codec(spark):
    import random

    from mirrorline.functions.hosts import punycode
    rnd = random.Random(3)
    labels = ["".join(rnd.choices("abz019-äöéßžλжשعक中日한🎉😀", k=rnd.randint(1, 40))) for _ in range(120)]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    got = [r[0] for r in df.select(punycode(F.col("x"))).collect()]
    assert got == [x.encode("punycode").decode() for x in labels]


def test_ipv4_and_ipv6_equal_the_library(spark):
    import ipaddress
    import random
    rnd = random.Random(4)
    numbers = [rnd.choice([0, rnd.getrandbits(8), rnd.getrandbits(32)]) for _ in range(60)]
    groups = [":".join(f"{rnd.choice([0, 0, rnd.getrandbits(16)]):x}" for _ in range(8)) for _ in range(80)]
    forms = [f(n) for n in numbers for f in (str, hex, lambda n: "0" + oct(n)[2:], lambda n: f"{n >> 24}.{n & 0xFFFFFF}", lambda n: f"0x{n >> 24:x}.{n >> 16 & 255}.{n & 0xFFFF}")]
    want = [f"http://{ipaddress.IPv4Address(n)}/" for n in numbers for _ in range(5)]
    forms += [f"[{g}]" for g in groups]
    want += [f"http://[{ipaddress.IPv6Address(g)}]/" for g in groups]
    df = spark.createDataFrame([(f"http://{h}/",) for h in forms], "u string").coalesce(1)
    assert [r[0] for r in df.select(U.normalize_url(F.col("u"))).collect()] == want


def test_a_rewritten_page_knows_odd_hosts(spark):
    from mirrorline.operators.rewrite import build_mirror
    rows = [("http://bücher.example/a/b", 200, "text/html", None, '<a href="//B%C3%9Ccher.example/c"> <a href="http://xn--bcher-kva.example/d"> <a href="http://bucher.example/e">', 1),
            ("http://[::1]/s.css", 200, "text/css", None, "url(http://[0:0::1]/i.png) url(http://[::2]/j.png)", 2)]
    df = spark.createDataFrame(rows, "url string, status int, content_type string, last_modified string, body string, seq bigint")
    got = {r["rtype"]: (r["site"], r["content"]) for r in build_mirror(df).collect()}
    assert got["page"] == ("xn--bcher-kva.example", '<a href="../../c/index.html"> <a href="../../d/index.html"> <a href="http://bucher.example/e">')
    assert got["css"] == ("[::1]", 'url("i.png") url(http://[::2]/j.png)')
