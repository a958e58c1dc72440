"""Deterministic inputs derived from the driver's ``pages`` and ``events``
tables for the parts of the dataflow those tables lack (media types, headers,
extra markup, stylesheets, robots files, render output, attempt logs, a
crawl graph). Every derivation is a projection of the given rows, so its size
grows with them, and the same expressions are written in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values used by the derivations (mirrored in the oracle SQL).
MEDIA_TYPES = ("text/html; charset=utf-8", "text/html", "text/css", "application/javascript",
               "image/png", "font/woff2", "application/json", None, "TEXT/HTML", "image/svg+xml")
LAST_MODIFIED = ("Mon, 01 Jan 2024 00:00:00 GMT", "", None)
ROBOTS_BODIES = (
    "User-agent: *\nDisallow: /en/\nAllow: /en/1\n",
    "# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr\nDisallow:\n",
    "user-agent: *\nDisallow: /es/\nUser-agent: *\r\nAllow: /es/9\nDisallow: /es/90\n",
    None,
)
STATUS_BY_EVENT = (("error", 503), ("click", 429), ("view", 200), ("signup", 404), ("purchase", None))


def _pick(values, idx_col):
    arr = F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values])
    return F.element_at(arr, (idx_col + 1).cast("int"))


def mixed_captures(pages: DataFrame) -> DataFrame:
    """Captures with varied media type, status and Last-Modified by page_id."""
    pid = F.col("page_id")
    return pages.select(
        F.col("url"),
        F.when(F.pmod(pid, F.lit(23)) == 7, F.lit(404)).otherwise(F.lit(200)).cast("int").alias("status"),
        _pick(MEDIA_TYPES, F.pmod(pid, F.lit(len(MEDIA_TYPES)))).alias("content_type"),
        _pick(LAST_MODIFIED, F.pmod(pid, F.lit(len(LAST_MODIFIED)))).alias("last_modified"),
        F.col("html").alias("body"),
        pid.cast("bigint").alias("seq"),
    )


def enriched_html(pages: DataFrame) -> DataFrame:
    """Pages with extra link-carrying markup appended by page_id residue:
    images with srcset and lazy attributes, a <base>, stylesheet/script/
    preload links, a service-worker script, single-quoted and unquoted values,
    and an entity in a value."""
    pid = F.col("page_id").cast("string")
    r = F.pmod(F.col("page_id"), F.lit(5))
    extra = (F.when(r == 0, F.concat(F.lit('<img src="/img/p'), pid, F.lit('.png" srcset="/img/p'), pid,
                                       F.lit('-2x.png 2x, /img/p'), pid, F.lit('-3x.png 3x" crossorigin="anonymous">')))
             .when(r == 1, F.concat(F.lit("<base href='/base/'><a href=rel/"), pid,
                                    F.lit("?a=1&amp;b=2>x</a><img data-src=\"lazy"), pid, F.lit('.jpg">')))
             .when(r == 2, F.concat(F.lit('<link rel="stylesheet" href="/css/site.css">'
                                          '<link rel="manifest" href="/m.json">'
                                          '<script src="/js/app.js"></script>'
                                          '<script src="/registerSW.js"></script>'
                                          '<link rel="modulepreload" href="/js/m.js">'),
                                    F.lit('<video src="/v/'), pid, F.lit('.mp4" poster="/v/p.jpg"></video>')))
             .when(r == 3, F.lit('<script>navigator.serviceWorker.register("/sw.js")</script>'
                                 '<source srcset="/s/a.webp 1x, , /s/b.webp 2x" data-lazy-src="/s/c.webp">'
                                 '<area href="//other.example.invalid/x"><a href="mailto:x@y">m</a>'))
             .otherwise(F.lit('<link rel="preload" as="script" href="/js/p.js"><a href="#top">t</a>'
                              '<audio src="/a/t.mp3"></audio>')))
    return pages.select("page_id", "url", F.concat(F.col("html"), extra).alias("html"))


def css_captures(pages: DataFrame) -> DataFrame:
    """One stylesheet per page, built from the page's own hrefs."""
    pid = F.col("page_id").cast("string")
    hrefs = F.regexp_extract_all(F.col("html"), F.lit('<a href="([^"]*)"'), 1)
    body = F.concat(
        F.lit("@import 'base"), pid, F.lit(".css';\nbody { background: url('/images/bg"), pid,
        F.lit(".png'); }\n.x { background: url(\"data:image/png;base64,iVBOR=\"); }\n"),
        F.array_join(F.transform(hrefs, lambda h: F.concat(F.lit(".i { background: url("), h, F.lit(") }"))), "\n"))
    url = F.concat(F.regexp_extract(F.col("url"), r"^(https?://[^/?#]*)", 1), F.lit("/css/s"), pid, F.lit(".css"))
    return pages.select(url.alias("url"), F.lit(200).cast("int").alias("status"),
                        F.lit("text/css").alias("content_type"),
                        F.lit(None).cast("string").alias("last_modified"),
                        body.alias("body"), F.col("page_id").cast("bigint").alias("seq"))


def rendered_from_pages(pages: DataFrame) -> DataFrame:
    """Render output per page: the final URL equals the request URL without
    fragment; requests are the page itself plus its hrefs (with fragments)."""
    origin = F.regexp_extract(F.col("url"), r"^(https?://[^/?#]*)", 1)
    hrefs = F.regexp_extract_all(F.col("html"), F.lit('<a href="([^"]*)"'), 1)
    reqs = F.concat(F.array(F.col("url")),
                    F.transform(hrefs, lambda h: F.concat(origin, h, F.lit("#frag"))),
                    F.array(F.lit("not a url"), F.lit("https://cdn.example.invalid/lib.js")))
    return pages.select(F.col("url"), F.regexp_replace(F.col("url"), "#.*$", "").alias("final_url"),
                        F.col("html"), reqs.alias("requested_urls"))


def robots_texts(pages: DataFrame) -> DataFrame:
    """One robots.txt body (or none) per site, chosen by the site name."""
    host = F.lower(F.regexp_extract(F.col("url"), r"^https?://([^/?#:]*)", 1))
    site = F.regexp_replace(host, r"^www\.", "")
    sites = pages.select(site.alias("site")).distinct()
    return sites.select("site", _pick(ROBOTS_BODIES, F.pmod(F.length("site"), F.lit(len(ROBOTS_BODIES))))
                        .alias("body"))


def attempts_from_events(events: DataFrame) -> DataFrame:
    """Attempt log: url per user, attempt number by (ts, event_id), status by
    event type (NULL = network error)."""
    from pyspark.sql import Window
    status = F.lit(None).cast("int")
    for et, st in reversed(STATUS_BY_EVENT):
        status = F.when(F.col("event_type") == et, F.lit(st).cast("int")).otherwise(status)
    url = F.concat(F.lit("https://shop"), F.pmod(F.col("user_id"), F.lit(5)).cast("string"), F.lit(".example.com/u/"),
                   F.col("user_id").cast("string"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(url.alias("url"), (F.row_number().over(w) - 1).cast("int").alias("attempt"),
                         status.alias("status"))


# Hosts as links spell them: names in other scripts, escapes, and addresses in every form.
HOST_FORMS = ("[::1]", "[0:0::1]:8080", "[2001:DB8:0:0:1:0:0:1]", "[1:2:0:0:0:6:0:0]", "[::ffff:192.0.2.1]", "[1::2::3]", "[::1", "[12345::]", "bücher.example", "BÜCHER.Example",
              "bu\u0308cher.example", "b%C3%BCcher.example", "a%2eb.com", "a%2Fb.com", "a%zz.com", "faß.de", "Straße.ẞ.de", "βόλος.com", "例え.テスト", "中国。中国", "ｆｕｌｌ．example",
              "☃.net", "x\u00ady.com", "\u0301a.com", "☃☃-a.b☃", "0x7f.1", "0X7F.0.0.1", "017700000001", "2130706433", "1.2.3", "1.2.3.4.", "256.1.1.1", "1.2.3.4.5", "09.1.1.1", "1.2.3.08", "4294967296",
              "0x.0x.0", "a.1.2.3.4", "1.2.3.4a", "www.1e3.example", "user:pw@HOST.example:80", "München.example:0443", "ex ample.com", "xn--bcher-kva.example", "bücher.中国.example")


def odd_addresses(pages: DataFrame) -> DataFrame:
    """One address per page whose host is spelt in one of the forms above, and a
    page that links to it."""
    pid = F.col("page_id")
    form = _pick(HOST_FORMS, F.pmod(pid, F.lit(len(HOST_FORMS))))
    url = F.concat(F.lit("http://"), form, F.lit("/p"), pid.cast("string"))
    return pages.select("page_id", url.alias("url"), F.concat(F.lit('<a href="'), url, F.lit('/sub">x</a>')).alias("html"))


def graph_edges(pages: DataFrame) -> DataFrame:
    """Two edges per page over the page_id ring: i -> (7i+1) mod N and
    i -> (3i+2) mod N, as URL pairs."""
    n = F.lit(pages.count()).cast("bigint")  # one scalar; the ring size
    p = pages.select("page_id", "url")
    e = p.select(F.col("page_id").alias("src_id"),
                 F.explode(F.array(F.pmod(F.col("page_id") * 7 + 1, n),
                                   F.pmod(F.col("page_id") * 3 + 2, n))).alias("dst_id"))
    src = p.select(F.col("page_id").alias("src_id"), F.col("url").alias("src_url"))
    dst = p.select(F.col("page_id").alias("dst_id"), F.col("url").alias("dst_url"))
    return e.join(src, "src_id").join(dst, "dst_id").select("src_url", "dst_url")


def repeated_captures(captures: DataFrame) -> DataFrame:
    """Captures with URLs fetched again (another body, a later seq, for every
    13th) and twins of every 17th whose host gains or loses "www.", which map
    to the same file."""
    return captures.unionByName(repeats(captures))


def repeats(captures: DataFrame) -> DataFrame:
    """What ``repeated_captures`` adds to the captures."""
    again = (captures.where(F.pmod(F.col("seq"), F.lit(13)) == 0)
             .withColumn("body", F.concat(F.col("body"), F.lit("<p>again</p>")))
             .withColumn("seq", F.col("seq") + 1_000_000_000))
    bare = F.regexp_replace(F.col("url"), "^(https?://)www[.]", "$1")
    twins = (captures.where(F.pmod(F.col("seq"), F.lit(17)) == 0)
             .withColumn("url", F.when(bare != F.col("url"), bare).otherwise(F.regexp_replace(F.col("url"), "^(https?://)", "$1www.")))
             .withColumn("seq", F.col("seq") + 2_000_000_000))
    return again.unionByName(twins)


def seed_inputs(pages: DataFrame) -> DataFrame:
    """Seeds as users type them: good ones and each kind of bad one."""
    url, r = F.col("url"), F.pmod(F.col("page_id"), F.lit(9))
    rest = F.regexp_replace(url, "^https?://", "")
    return pages.select(F.when(r == 0, F.concat(F.lit("ftp://"), rest)).when(r == 1, rest).when(r == 2, F.lit("http:///x"))
                        .when(r == 3, F.concat(F.lit("  HTTPS://"), rest)).when(r == 4, F.concat(F.lit("https://a b/"), rest))
                        .when(r == 5, F.concat(F.lit("mailto:"), rest)).otherwise(url).alias("seed_url"))


def spa_html(pages: DataFrame) -> DataFrame:
    """Pages of every site type: as they are, with a framework's marker, shells
    with a mount point and text around the thresholds, many scripts."""
    r, n = F.pmod(F.col("page_id"), F.lit(6)), F.col("page_id")
    head = "<!doctype html><html><head><title>t</title></head><body>"
    html = (F.when(r == 1, F.concat(F.col("html"), F.lit("<div data-reactroot></div>")))
            .when(r == 2, F.concat(F.lit(head + '<div id="app"></div><script type="module" src="/a.js"></script><p>'), F.repeat(F.lit("x"), F.pmod(n * 7, F.lit(700)).cast("int")), F.lit("</p>")))
            .when(r == 3, F.concat(F.lit(head + "<script>for(i=0;i<n;i++){}</script><script src=/b.js></script><script type='module'></script>"), F.repeat(F.lit("y "), F.pmod(n * 5, F.lit(120)).cast("int"))))
            .when(r == 4, F.concat(F.lit(head + "<main id=q-app></main><p>&eacute;&#8364;&ampx;"), F.repeat(F.lit("z"), F.pmod(n, F.lit(50)).cast("int"))))
            .when(r == 5, F.concat(F.lit(head + '<div id="root"></div><noscript>'), F.col("page_id").cast("string"), F.lit("</noscript>")))
            .otherwise(F.col("html")))
    return pages.select("page_id", "url", html.alias("html"))


CRAWL_SITES, CRAWL_FAN = 8, 4


def _crawl_url(number):
    """Address of a page by its number: eight sites, whose names differ in length,
    and three languages."""
    site = F.pmod(number, F.lit(CRAWL_SITES))
    lang = _pick(("en", "fr", "es"), F.pmod(number, F.lit(3)))
    return F.concat(F.lit("https://s"), site.cast("string"), F.repeat(F.lit("x"), F.pmod(site, F.lit(4)).cast("int")),
                    F.lit(".example/"), lang, F.lit("/"), number.cast("string"))


def crawl_pages(pages: DataFrame) -> DataFrame:
    """Pages whose links form a tree per site (page n of a site links to pages
    4n + 1 to 4n + 4), beside the links they have."""
    pid = F.col("page_id").cast("bigint")
    rank = F.floor(pid / CRAWL_SITES)
    linked = [F.concat(F.lit('<a href="'), _crawl_url((rank * CRAWL_FAN + k) * CRAWL_SITES + F.pmod(pid, F.lit(CRAWL_SITES))), F.lit('">n</a>')) for k in range(1, CRAWL_FAN + 1)]
    return pages.select("page_id", _crawl_url(pid).alias("url"), F.concat("html", *linked).alias("html"))


def crawl_seeds(pages: DataFrame) -> DataFrame:
    """The first page of each site."""
    p = crawl_pages(pages.where(F.col("page_id") < CRAWL_SITES))
    return p.select(F.regexp_extract("url", "^https://([^/]*)", 1).alias("site"), F.col("url").alias("seed_url"))


def capture_lines(pages: DataFrame) -> DataFrame:
    """Captures as JSON lines, with each kind of bad record among them."""
    pid = F.col("page_id").cast("string")
    r = F.pmod(F.col("page_id"), F.lit(13))
    url = (F.when(r == 1, F.lit("null")).when(r == 2, F.lit('"no address"')).when(r == 8, F.lit('" "'))
           .otherwise(F.concat(F.lit('"'), F.col("url"), F.lit('"'))))
    status = (F.when(r == 3, F.lit("null")).when(r == 4, F.lit("404")).when(r == 5, F.lit('"soon"')).when(r == 9, F.lit("503")).otherwise(F.lit("200")))
    seq = F.when(r == 6, F.lit("null")).otherwise(pid)
    body = F.regexp_replace("html", "[^A-Za-z0-9<>/ ]", "")
    line = F.concat(F.lit('{"url":'), url, F.lit(',"status":'), status, F.lit(',"seq":'), seq, F.lit(',"content_type":"text/html","body":"'), body)
    return pages.select(F.when(r == 0, line).when(r == 7, F.lit("<html>")).otherwise(F.concat(line, F.lit('"}'))).alias("value"))
