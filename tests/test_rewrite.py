from pyspark.sql import functions as F

from mirrorline.functions import html as H
from mirrorline.functions import urls as U
from mirrorline.operators.rewrite import rewrite_css, rewrite_html


SAME_SITE = ('<p><a class="n" href="../setup/@step=2/index.html">next</a> <a href="../index.html">up</a> '
             '<a href="../../files/list.pdf">list</a> <a href="//cdn.shop.test/x.png">elsewhere</a> '
             '<a href="mailto:me@shop.test">mail</a> <a href="index.html">self</a></p>')
SETS = ('<img srcset="a/one.png 1x, ../two.png 2.5x, https://far.test/three.png 3x" alt="b, c">'
        '<source srcset="https://far.test/wide.webp 800w, https://far.test/thin.webp 80w"><img srcset="../only.gif">')
STYLES = ('@import url("../base/reset.css") screen;\n@import url(fonts.css);\n.a{background:url("../img/tile.gif") no-repeat}'
          ".b{src:url(\"../type/a.woff2\") format('woff2'),url('https://far.test/a.woff')}.c{mask:url(data:image/svg+xml;utf8,<svg/>)}.d{fill:url(#grad)}")


def _rw(spark, url, html):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    df = df.select("html", U.parsed("url").alias("u"), U.hosts_in("html").alias("hosts"))
    return df.select(rewrite_html(F.col("html"), F.col("u"), F.col("hosts"))).first()[0]


def test_links_of_the_own_site_become_relative(spark):
    html = ('<p><a class="n" href="https://WWW.shop.test/guide/setup/?step=2#top">next</a> <a href="../">up</a> '
            '<a href="http://shop.test/files/list.pdf">list</a> <a href="//cdn.shop.test/x.png">elsewhere</a> '
            '<a href="mailto:me@shop.test">mail</a> <a href="">self</a></p>')
    out = _rw(spark, "https://shop.test/guide/start/", html)
    assert out == SAME_SITE


def test_sets_of_images_keep_descriptors(spark):
    html = ('<img srcset=" a/one.png 1x,https://shop.test/two.png  2.5x , https://far.test/three.png 3x" alt="b, c">'
            '<source srcset="https://far.test/wide.webp 800w, https://far.test/thin.webp 80w"><img srcset="/only.gif">')
    out = _rw(spark, "https://shop.test/pics/", html)
    assert out == SETS


def test_readme_vectors(spark):
    out = _rw(spark, "https://example.com/",
              '<a href="/about">a</a><img src="/images/logo.png"><a href="https://other.org/x">x</a>'
              '<a href="#section">s</a>')
    assert 'href="about/index.html"' in out and 'src="images/logo.png"' in out
    assert 'href="https://other.org/x"' in out and 'href="#section"' in out


def test_root_link_kept_on_root_page(spark):
    assert _rw(spark, "https://example.com/", '<a href="/">r</a>') == '<a href="/">r</a>'


def test_single_quotes_not_rewritten(spark):
    assert _rw(spark, "https://example.com/", "<a href='/about'>a</a>") == "<a href='/about'>a</a>"


def test_offline_breakers(spark):
    html = ('<link rel="manifest" href="/m.json"><link rel="modulepreload" href="/m.js">'
            '<link rel="preload" href="/p.js" as="script"><script src="/registerSW.js"></script>'
            '<script>navigator.serviceWorker.register("/sw.js")</script><script>ok()</script>'
            '<img crossorigin="anonymous" src="x.png">')
    out = spark.createDataFrame([(html,)], "h string").select(H.strip_offline_breakers(F.col("h"))).first()[0]
    assert out == '<script>ok()</script><img src="x.png">'


def test_style_sheets(spark):
    css = ("@import 'https://shop.test/base/reset.css' screen;\n@import url(fonts.css);\n.a{background:url( /img/tile.gif ) no-repeat}"
           ".b{src:url(\"../type/a.woff2\") format('woff2'),url('https://far.test/a.woff')}.c{mask:url(data:image/svg+xml;utf8,<svg/>)}.d{fill:url(#grad)}")
    df = spark.createDataFrame([("https://shop.test/theme/main.css", css)], "u string, c string")
    df = df.select("c", U.parsed("u").alias("u"), U.hosts_in("c").alias("hosts"))
    assert df.select(rewrite_css(F.col("c"), F.col("u"), F.col("hosts"))).first()[0] == STYLES


def test_strip_scripts_and_visible_text(spark):
    df = spark.createDataFrame([("<p>a<SCRIPT src=x>1</script>b</p> c>d",)], "h string")
    r = df.select(H.strip_scripts(F.col("h")), H.visible_text(F.col("h"))).first()
    assert r[0] == "<p>ab</p> c>d" and r[1] == "a1b cd"
