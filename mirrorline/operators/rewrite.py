"""Corpus rewriting for offline reading: captures -> mirror.

Map-only. Each document is cut once by ``split`` at the attribute pattern and
the matches are taken once by ``regexp_extract_all``; ``zip_with`` rebuilds
the document with every rewritten value, so no row ever leaves its task and
the plan has no Exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as TX
from ..functions import urls as U
from ..functions.columns import once
from ..functions.urls import WS, let, nstruct

# Attribute and CSS patterns of the rewriter.
# White space comes before a name, taken from its first character; most characters
# are none, which the first two classes tell without trying every kind of it.
ATTR_REWRITE_RE = (rf"[^!-~](?=[{WS}hHsSaApP])(?<=[{WS}])(?<![{WS}]{{2}})[{WS}]*+"
                   rf"(?i)(href|src|action|poster|srcset)[{WS}]*+=[{WS}]*+\"([^\"]*+)\"")
BASE_HREF_RE = rf"(?is).*href[{WS}]*+=[{WS}]*+[\"']([^\"']+)[\"']"
# url(...) with its target as group 1, else up to the next ")" without one (a bad
# url by the standard); import with its target as group 2.
CSS_URL_RE = (rf"url\((?:[{WS}]*+(?!\))|[{WS}]*(?=[{WS}]\)))['\"]?+([^'\")]++)['\"]?+[{WS}]*+\)"
              r"|url\([^)]*+(?:\)|\z)")
CSS_IMPORT_RE = rf"@import[{WS}]++['\"]([^'\"]++)['\"]"
CSS_REF_RE = CSS_URL_RE.replace("|url", f"|{CSS_IMPORT_RE}|url")
EARLY_OUT_MARKERS = ("href=", "src=", "srcset=", "data-src")


def rewrite_value(value_col: Column, base: Column, page_path: Column, hosts: Column) -> Column:
    """New relative path for one attribute value, or NULL to keep it. ``hosts``:
    the document's odd hosts (see ``urls.odd_hosts``)."""
    def decide(r):
        target = U.offline_path(r["path"], r["query"])

        def finish(new):
            return F.when((new == value) | (new == ".") | (new == page_path), F.lit(None)).otherwise(new)

        same = U.site_of(r["host"]) == U.site_of(base["host"])
        return F.when(r.isNotNull() & same, let(let(target, lambda t: U.relative_link(page_path, t)), finish))

    def run(v):
        nonlocal value
        value = v
        return F.when(U.skip_reference(v), F.lit(None)).otherwise(let(U.resolve(base, v, hosts), decide))

    value = None
    return let(value_col, run)


def _rewrite_match(m: Column, base: Column, page_path: Column, hosts: Column) -> Column:
    """One attribute with its value rewritten. A srcset value is its candidates,
    whose descriptors stay; any other value is one candidate."""
    def candidates(g):
        items = F.filter(F.transform(F.split(g["value"], ","), lambda p: U.trim_ws(p)), lambda p: p != "")
        listed = F.transform(items, lambda p: nstruct(
            tok=F.regexp_extract(p, f"^([^{WS}]+)", 1),
            desc=F.regexp_replace(U.trim_ws(F.regexp_replace(p, f"^[^{WS}]+", "")), f"[{WS}]+", " ")))
        return F.when(g["srcset"], listed).otherwise(F.array(nstruct(tok=g["value"], desc=F.lit(""))))

    def render(g):
        def joined(arr):
            text = F.array_join(F.transform(arr, lambda x: F.concat(
                F.coalesce(x["new"], x["tok"]), F.when(x["desc"] != "", F.concat(F.lit(" "), x["desc"])).otherwise(F.lit("")))), ", ")
            return F.when(F.exists(arr, lambda x: x["new"].isNotNull()), F.concat(g["prefix"], F.lit('="'), text, F.lit('"'))).otherwise(m)
        found = F.transform(candidates(g), lambda x: nstruct(new=rewrite_value(x["tok"], base, page_path, hosts), tok=x["tok"], desc=x["desc"]))
        return let(found, joined)

    # The match is the attribute pattern's: white space, name, "=", the value in quotes.
    prefix = F.regexp_extract(m, f"^([{WS}]+[A-Za-z]+)", 1)
    quoted = F.substring_index(m, '"', -2)
    return let(nstruct(prefix=prefix, srcset=F.lower(prefix).endswith("srcset"), value=F.regexp_replace(quoted, '"$', "")), render)


def rewrite_html(html: Column, page: Column, hosts: Column) -> Column:
    """Rewrite double-quoted href/src/action/poster/srcset values of one
    document to offline relative paths, then remove offline breakers.
    ``page`` (the parsed page URL struct) and ``hosts`` (the document's odd
    hosts) are columns of an earlier projection: inlined, they would nest lambdas
    deeper than the analyzer goes."""
    def run(ctx):
        h, base, page_path = ctx["html"], ctx["base"], ctx["page_path"]
        parts = F.split(h, ATTR_REWRITE_RE)
        matches = F.regexp_extract_all(h, U.lit_re(ATTR_REWRITE_RE), 0)
        rebuilt = F.array_join(F.zip_with(parts, matches, lambda p, m: F.concat(
            p, F.when(m.isNull(), F.lit("")).otherwise(_rewrite_match(m, base, page_path, hosts)))), "")
        has_marker = F.lit(False)
        for mk in EARLY_OUT_MARKERS:
            has_marker = has_marker | h.contains(mk)
        return H.strip_offline_breakers(F.when(has_marker, rebuilt).otherwise(h))

    hrefs = F.transform(H.base_attrs(html), lambda a: F.regexp_extract(a, BASE_HREF_RE, 1))
    base_href = F.get(F.filter(hrefs, lambda v: v != ""), F.lit(0))
    base = F.coalesce(F.when(base_href.isNotNull(), U.resolve(page, base_href, hosts)), page)
    ctx = nstruct(html=html, base=base, page_path=U.offline_path(page["path"], page["query"]))
    return let(ctx, run)


def rewrite_css(css: Column, css_url: Column, hosts: Column) -> Column:
    """Rewrite url(...) and @import targets of a stylesheet to offline
    relative paths; data: URIs and unresolvable values stay as they are.
    ``@import "x"`` keeps its keyword: ``@import url("rel")``."""
    def run(ctx):
        c, base, path = ctx["css"], ctx["base"], ctx["path"]
        parts = F.split(c, CSS_REF_RE)
        matches = F.regexp_extract_all(c, U.lit_re(CSS_REF_RE), 0)

        def one(m):
            def run_m(g):
                new = F.when((g["text"] == "") | g["text"].startswith("data:"), F.lit(None)).otherwise(
                    rewrite_value(g["text"], base, path, hosts))
                return let(new, lambda n: F.when(n.isNull(), m).otherwise(F.concat(
                    F.when(g["imp"], F.lit("@import ")).otherwise(F.lit("")), F.lit('url("'), n, F.lit('")'))))
            url_text = F.regexp_extract(m, CSS_REF_RE, 1)
            imp_text = F.regexp_extract(m, CSS_REF_RE, 2)
            g = nstruct(imp=m.startswith("@import"),
                        text=F.when(m.startswith("@import"), imp_text).otherwise(url_text))
            return let(g, run_m)

        return F.array_join(F.zip_with(parts, matches, lambda p, m: F.concat(
            p, F.when(m.isNull(), F.lit("")).otherwise(one(m)))), "")

    ctx = nstruct(css=css, base=css_url, path=U.offline_path(css_url["path"], css_url["query"]))
    return let(ctx, run)


def build_mirror(captures: DataFrame) -> DataFrame:
    """mirror(site, offline_path, url, rtype, content, size, hash, out_size,
    out_hash, last_modified, seq): pages and CSS rewritten, everything else
    stored as captured. ``size``/``hash`` describe the captured body (what the
    manifest records), ``out_*`` the stored content.

    Bodies may be BINARY: pages and CSS are then read as UTF-8 with U+FFFD for
    malformed bytes, other resources are stored byte for byte, and ``content``
    is binary."""
    binary = dict(captures.dtypes)["body"] == "binary"
    raw = F.col("body")
    text = F.make_valid_utf8(raw.cast("string")) if binary else raw
    df = (once(captures, "_u", U.parsed("url"))
          .where(F.col("_u").isNotNull())
          .withColumn("rtype", U.classify_resource(F.col("content_type"), F.col("_u.path")))
          .withColumn("_hosts", F.when(F.col("rtype").isin("page", "css"), U.odd_hosts(text))))
    hosts = F.col("_hosts")
    kind = "binary" if binary else "string"
    content = (F.when(F.col("rtype") == "page", rewrite_html(text, F.col("_u"), hosts).cast(kind))
               .when(F.col("rtype") == "css", rewrite_css(text, F.col("_u"), hosts).cast(kind))
               .otherwise(raw))
    out = df.select(
        U.site_of(F.col("_u.host")).alias("site"),
        U.offline_path(F.col("_u.path"), F.col("_u.query")).alias("offline_path"),
        U.serialize(F.col("_u")).alias("url"), "rtype", content.alias("content"),
        TX.byte_size(raw).alias("size"), TX.content_hash(raw).alias("hash"),
        "last_modified", "seq")
    return (out.withColumn("out_size", TX.byte_size(F.col("content")))
            .withColumn("out_hash", TX.content_hash(F.col("content"))))


def rewrite_rendered(rendered: DataFrame) -> DataFrame:
    """Rendered pages as mirror rows: scripts removed first, then rewritten
    against the final URL (the URL the browser ended on). Their size and hash
    are those of the rewritten page; there is no Last-Modified."""
    df = (rendered.withColumn("_u", U.parsed("final_url"))
          .where(F.col("_u").isNotNull())
          .withColumn("_html", H.strip_scripts(F.col("html"))).withColumn("_hosts", U.hosts_in("_html")))
    content = rewrite_html(F.col("_html"), F.col("_u"), F.col("_hosts"))
    seq = F.col("seq") if "seq" in rendered.columns else F.lit(0).cast("bigint")
    out = df.select(U.site_of(F.col("_u.host")).alias("site"),
                    U.offline_path(F.col("_u.path"), F.col("_u.query")).alias("offline_path"),
                    U.serialize(F.col("_u")).alias("url"), F.lit("page").alias("rtype"),
                    content.alias("content"), F.lit(None).cast("string").alias("last_modified"), seq.alias("seq"))
    return (out.withColumn("size", TX.byte_size(F.col("content"))).withColumn("hash", TX.content_hash(F.col("content")))
            .withColumn("out_size", F.col("size")).withColumn("out_hash", F.col("hash")))
