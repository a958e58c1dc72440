import html
import re
import time

import pytest

from mirrorline.llm import main_text as M

SF = "/root/testdata/sf0.01"


def _run(spark, rows, **kw):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string").repartition(2)
    return {r["page_id"]: r["text"] for r in M.main_text(pages, **kw).collect()}


def text(source):
    return M.PageTree(source, 1).text


def test_given_pages_keep_their_articles_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in M.op11_main_text(spark, SF).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search("<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        plain = re.sub("<[^>]*>", "", re.sub("<(/?(p|h1)|br)>", " ", article))
        assert got[r["page_id"]]["text"] == " ".join(html.unescape(plain).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def _site(n, host="h.example"):
    """Pages without any naming mark-up: a strip and a tail alike on all pages."""
    return [(i, f"http://{host}/{i}", f"<body><div class=x1><a href=/a>Start</a> <a href=/b>News</a></div><div class=x2><p>Story {i} of day {i * 7}.</p><p>More {i}.</p></div>"
             f"<div class=x3>All rights reserved.</div></body>") for i in range(n)]


def test_branches_alike_on_all_pages_of_a_host_are_cut(spark):
    got = _run(spark, _site(12))
    assert got == {i: f"Story {i} of day {i * 7}. More {i}." for i in range(12)}


def test_few_pages_and_copies_say_nothing(spark):
    few = _site(3)
    assert _run(spark, few)[0].startswith("Start News Story 0")
    copies = [(i, f"http://h.example/{i}", few[0][2]) for i in range(30)]  # one distinct page
    assert set(_run(spark, copies).values()) == {"Start News Story 0 of day 0. More 0. All rights reserved."}


def test_a_shared_branch_is_cut_on_its_own_host_only(spark):
    rows = _site(12) + [(100, "http://other.example/", _site(1)[0][2])]
    assert "All rights reserved." in _run(spark, rows)[100]


def test_an_article_is_never_cut_however_often_it_stands(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=x><i>{i}</i></div><article><p>Same words.</p></article>") for i in range(20)]
    assert all(t.endswith("Same words.") for t in _run(spark, rows).values())


@pytest.mark.parametrize("source,want", [
    ("<p>a<b>b</b>c<br>d</p>e", "abc d e"),
    ("<p>x &amp; y&nbsp;z &#8364; &ampq &bogus; &am", "x & y z € &q &bogus; &am"),
    ("<article><header><h1>T</h1></header><p>one</p><footer>f</footer><aside>s</aside></article><header>no</header>", "T one"),
    ("<div class='page has-sidebar'><p>in</p></div><div class=sideBar>out</div><div id=cookie-notice>out</div>", "in"),
    ("<div class=ad2>out</div><form><p>out</form><script>var a='</p>'</script><style>p{}</style><!-- <p>out -->in", "in"),
    ("<article><p>in</p></article><section id=comments><article><p>reader</p></article></section>", "in"),
    ("<div class=banner><article>in</article>out</div>", "in"),
    ("<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl><table><tr><td>e<td>f</table>", "a b c d e f"),
    ("<p title='a > b' x=\"<i>\">in</p><p hidden>out</p>1 < 2", "in 1 < 2"),
    ("<article>in</article><p>cut <a href='x", "in cut"),
    ("", ""), ("plain", "plain"), ("<script>never ends", ""), ("<!-- never ends", ""), ("a</>b<!x>c<?y>d</ z>e", "abcde"),
])
def test_pages(source, want):
    assert text(source) == want


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "x", ""), (2, "http://h/", "<p>a"), (2, "http://h/", "<p>a"), (3, "", "<p>" + "word " * 100000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r["page_id"], r["url"], len(r["text"]), r["n_chars"]) for r in M.main_text(pages).collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (None, "x", 0, 0), (2, "http://h/", 1, 1), (2, "http://h/", 1, 1), (3, "", 499999, 499999)], key=str)
    assert M.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<div>", "<p>", "<b>", "<a ", "<a href='", "<!--", "</div>", "<", "&", "<li>", "<script>", "<td>", "<p><table>", "=", "<a b=c "])
def test_long_hostile_pages_take_linear_time(unit):
    began = time.time()
    M.PageTree(unit * (600_000 // len(unit)), 1)
    assert time.time() - began < 6
