"""Main text of pages by a site style tree.

The pages of one host are merged into a tree of block elements: a node is the
path of names, classes and ids that leads to it. Over the host's distinct pages
each node has an importance between 0 and 1:

* presentation: the entropy of the child sequences that it has on its pages, to
  the base of their number (one sequence on all pages: 0);
* content: 1 less the mean entropy of its features (the texts of its blocks and
  the targets of its links) over the pages, where a feature's entropy is the
  logarithm of the pages that have it, to the same base (on all pages: 1);
* together ``(1 - G**s) * presentation + G**s * content`` with s sequences.

A branch is as important as its most important node. Branches below
``THRESHOLD`` on hosts with at least ``MIN_PAGES`` pages are cut from each page.

Names say what statistics cannot, as when every page of a host has another
advert: elements that the standard or their class, id or role names as menus,
headers, footers, sidebars, notices, adverts, forms or comments have importance
0, ``article`` and ``main`` have 1; the tree decides about all the others.

What crosses the network is one row per page, node and feature, of 64-bit
hashes; identical pages of a host count once, counts are combined before they
are shuffled, and logarithms are added as integers, so that the order of rows
does not matter. Pages are read once to build the tree and once to cut them.

Defined cases: null html is empty and gives ''; a null or odd address belongs
to the host ''; equal rows give equal rows; a host of fewer pages loses no
branch to the tree; unclosed tags and comments run to the end of the page;
elements nested deeper than ``MAX_DEPTH`` count to the node at that depth; an
empty table gives no rows. Extra columns pass by unread.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, table

THRESHOLD = 0.3
MIN_PAGES = 4
DAMPING = 0.9
MAX_DEPTH = 64
#: Logarithms are counted in 2**-LOG_BITS.
LOG_BITS = 20

# Elements of HTML by what they are to a reader.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
                   "summary table caption tbody td tfoot th thead tr ul noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title iframe noembed noframes xmp".split())
NEVER_TEXT = frozenset("head script style textarea title iframe noembed noframes noscript template object svg canvas audio video map "
                       "nav aside footer menu dialog form fieldset button select datalist search".split())
MAIN = frozenset(("article", "main"))
# A start tag of the first kind ends an open element of the second kind, within the third.
P_ENDERS = BLOCKS - frozenset("body caption dd dt head html legend li noscript iframe optgroup option rp rt tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"),
        "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tbody", "thead"), "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead")}
LIMITS = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",),
          "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
# Words of a class, id or role that name what is not the article.
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation "
                        "menu menubar breadcrumb breadcrumbs pagination pager sidebar aside complementary footer contentinfo header masthead topbar "
                        "toolbar cookie cookies consent gdpr notice notices notification alert dialog popup modal overlay newsletter subscribe "
                        "subscription signup login search form share sharing social related recommended widget widgets".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
HEADER_WORDS = frozenset("header banner".split())
NOT_WORDS = frozenset("no not without has have with".split())

_START = re.compile(r"<([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(>?)", re.A)
_ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?+", re.A)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.A | re.I) for n in RAW_TEXT}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER = re.compile(r"[0-9]{3,}")  # a running number in a class or id


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashed(text: str, seed: int = 0) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF))


def named_noise(names: str) -> tuple[bool, bool, bool]:
    """(noise, reader comments, noise only as a header) by classes, ids and roles."""
    noise = comments = header = False
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)} | set(re.findall("[a-z]+", name.lower()))
        if words & NOT_WORDS:
            continue
        comments = comments or bool(words & COMMENT_WORDS)
        found = words & NOISE_WORDS
        noise = noise or bool(found - HEADER_WORDS)
        header = header or bool(found)
    return noise, comments, header and not noise


class _Element:
    """An open element. ``state``: 'tree' (the style tree decides), 'kept' (inside
    article or main), 'named' (cut by its class) or 'gone' (cut for good)."""
    __slots__ = ("name", "node", "state", "block", "depth")

    def __init__(self, name, node, state, block, depth):
        self.name, self.node, self.state, self.block, self.depth = name, node, state, block, depth


class PageTree:
    """One page: its blocks of text in order, and what its nodes contribute to
    the host's tree. ``noise``: nodes whose branches are cut."""

    def __init__(self, source: str, host: int, noise: frozenset[int] = frozenset()):
        self.noise = noise
        self.texts: list[str] = []
        self.styles: dict[int, list[str]] = {}
        self.features: dict[int, set[int]] = {}
        self.above: dict[int, tuple[int, ...]] = {}
        self._held: list[str] = []
        self._node_of_held = None
        self._open: dict[str, int] = {}
        self._stack = [_Element("", host, "tree", True, 0)]
        self._read(source)
        self._flush()

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                return
            if lt > at:
                self._text(s[at:lt])
            after = s[lt + 1: lt + 2]
            if after.isascii() and after.isalpha():
                m = _START.match(s, lt)
                if not m[3]:  # the page ends inside a tag
                    return
                at = m.end()
                name = m[1].lower()
                self._start(name, m[2])
                if name in RAW_TEXT:
                    end = _RAW_END[name].search(s, at)
                    at = end.start() if end else n
            elif s.startswith("<!--", lt):
                if s.startswith("<!-->", lt) or s.startswith("<!--->", lt):
                    at = s.index(">", lt) + 1
                else:
                    end = s.find("-->", lt + 4)
                    at = end + 3 if end >= 0 else n
            elif after == "/" and s[lt + 2: lt + 3].isascii() and s[lt + 2: lt + 3].isalpha():
                end = s.find(">", lt)
                if end < 0:
                    return
                self._end(re.split(r"[\s/]", s[lt + 2: end], maxsplit=1)[0].lower())
                at = end + 1
            elif after and after in "!?/":
                end = s.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                self._text("<")
                at = lt + 1

    def _text(self, raw: str) -> None:
        top = self._stack[-1]
        if top.state == "tree" or top.state == "kept":
            self._held.append(references.unescape(raw) if "&" in raw else raw)
            self._node_of_held = top

    def _flush(self) -> None:
        if not self._held:
            return
        text = " ".join("".join(self._held).split())
        self._held = []
        if text:
            self.texts.append(text)
            if self._node_of_held.state == "tree":
                self.features.setdefault(self._node_of_held.node, set()).add(hashed(text))

    def _pop(self, upto: int) -> None:
        for e in self._stack[upto:]:
            self._open[e.name] -= 1
            if e.block:
                self._flush()
        del self._stack[upto:]

    def _close(self, names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        if not any(self._open.get(n) for n in names):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            name = self._stack[i].name
            if name in names:
                self._pop(i)
                return
            if name in limits:
                return

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if self._open.get(name):
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i].name == name:
                    self._pop(i)
                    return

    def _start(self, name: str, attrs: str) -> None:
        block = name in BLOCKS
        if block:
            self._flush()
            if name in P_ENDERS:
                self._close(("p",), ("table", "td", "th", "caption", "button", "object"))
        if name in ENDS:
            self._close(ENDS[name], LIMITS[name])
        values = {}
        if attrs:
            for k, a, b, c in _ATTR.findall(attrs):
                values.setdefault(k.lower(), a or b or c)
        top = self._stack[-1]
        if name == "br" and top.state in ("tree", "kept"):
            self._held.append(" ")
            self._node_of_held = self._node_of_held or top
        if name == "a" and top.state == "tree" and values.get("href"):
            self.features.setdefault(top.node, set()).add(hashed("href " + values["href"]))
        node, depth = top.node, top.depth
        if block and depth < MAX_DEPTH:
            labels = sorted(_NUMBER.sub("0", f"{values.get('class', '')} #{values.get('id', '')}").split())
            sign = " ".join([name, *labels])
            if top.state == "tree":
                self.styles.setdefault(top.node, []).append(sign)
            node, depth = hashed(sign, top.node), depth + 1
        if name in VOID:
            return
        state = self._state(name, values, top, node, block)
        if block and state == "tree" and node != top.node and node not in self.above:
            self.above[node] = (*self.above.get(top.node, ()), node)
            self.styles.setdefault(node, [])
        self._open[name] = self._open.get(name, 0) + 1
        self._stack.append(_Element(name, node, state, block, depth))

    def _state(self, name, values, top, node, block) -> str:
        if top.state == "gone" or name in NEVER_TEXT or "hidden" in values:
            return "gone"
        noise = comments = header = False
        names = " ".join(values[k] for k in ("class", "id", "role") if values.get(k))
        if names and name not in ("html", "body"):
            noise, comments, header = named_noise(names)
        if comments:
            return "gone"
        inside = top.state == "kept"
        if noise or ((header or name == "header") and not inside):
            return "named"
        if name in MAIN or values.get("role") == "main":
            return "kept"
        if top.state == "tree" and block and node in self.noise:
            return "named"
        return top.state

    @property
    def text(self) -> str:
        return " ".join(self.texts)


def _tree_rows(batches):
    """(node, kind, feature, page): kind 0 a node's child sequence on a page, 1 a
    feature of it, 2 a node above it (or itself), 3 its host."""
    for batch in pieces(batches, "html"):
        cols = [[], [], [], []]

        def add(node, kind, feature, page):
            for c, v in zip(cols, (node, kind, feature, page), strict=True):
                c.append(v)

        known = set()
        for source, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tree, page = PageTree(source, host), hashed(source, host)
            for node, above in tree.above.items():
                add(node, 0, hashed("\n".join(tree.styles[node])), page)
                for f in tree.features.get(node, ()):
                    add(node, 1, f, page)
                if node not in known:
                    known.add(node)
                    for a in above:
                        add(node, 2, a, 0)
                    add(node, 3, host, 0)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["node", "kind", "feature", "page"])


def _log(c):
    """Fixed-point logarithm, so that sums are exact."""
    return F.floor(F.log(c) * (1 << LOG_BITS)).cast("decimal(38,0)")


def importance(counted: DataFrame) -> DataFrame:
    """(node, pages, importance) from counted(node, kind, feature, n): on how many
    distinct pages a node has a child sequence or feature."""
    style, content = F.col("kind") == 0, F.col("kind") == 1
    sums = counted.where("kind < 2").groupBy("node").agg(
        F.sum(F.when(style, F.col("n"))).alias("pages"), F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, F.col("n") * _log(F.col("n")))).cast("double").alias("style_logs"),
        F.count(F.when(content, 1)).alias("features"),
        F.sum(F.when(content, _log(F.col("n")))).cast("double").alias("feature_logs"))
    base = F.log("pages") * (1 << LOG_BITS)
    damp = F.pow(F.lit(DAMPING), F.col("styles"))
    presented = 1 - F.col("style_logs") / F.col("pages") / base
    held = F.when(F.col("features") > 0, 1 - F.coalesce("feature_logs", F.lit(0.0)) / F.col("features") / base).otherwise(0.0)
    return sums.select("node", "pages", F.when(F.col("pages") > 1, (1 - damp) * presented + damp * held).otherwise(1.0).alias("importance"))


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, _host): null html is '', _host is the host's hash."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*([^/\\?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.xxhash64(host).alias("_host"))


def site_noise(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, nodes): the nodes of each host whose branches are cut; pages as
    ``with_host`` gives them. A node is cut only if several pages share it, so
    the array is a fraction of the host's nodes."""
    rows = pages.select("html", "_host").mapInArrow(_tree_rows, "node bigint, kind int, feature bigint, page bigint")
    counted = stored(rows.distinct().groupBy("node", "kind", "feature").agg(F.count("*").alias("n")))
    nodes = importance(counted)
    above = counted.where("kind = 2").select("node", F.col("feature").alias("branch"))
    branches = above.join(nodes, "node").groupBy("branch").agg(
        F.max("importance").alias("importance"), F.max(F.when(F.col("node") == F.col("branch"), F.col("pages"))).alias("pages"))
    cut = branches.where((F.col("importance") < threshold) & (F.col("pages") >= min_pages)).select(F.col("branch").alias("node"))
    hosts = counted.where("kind = 3").select("node", F.col("feature").alias("host"))
    return stored(cut.join(hosts, "node").groupBy("host").agg(F.collect_set("node").alias("nodes")))


def _extract(batches):
    for batch in pieces(batches, "html"):
        hosts, noise = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        sets: dict[int, frozenset] = {}
        texts = []
        for source, host, nodes in zip(batch.column(2).to_pylist(), hosts, noise, strict=True):
            if host not in sets:
                sets[host] = frozenset(nodes or ())
            texts.append(PageTree(source, host, sets[host]).text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))],
            ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page. pages(page_id, url, html)."""
    pages = with_host(pages)
    # The table of cut nodes is stored, so its size tells whether the join may broadcast it.
    noise = site_noise(pages, threshold, min_pages).withColumnRenamed("host", "_host")
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return (pages.join(noise, "_host", "left").select("page_id", "url", "html", "_host", "nodes")
            .mapInArrow(_extract, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint"))


def op11_main_text(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``pages`` table."""
    return main_text(table(spark, sf_dir, "pages"))
