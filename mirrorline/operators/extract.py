"""Link extraction jobs: captures -> links.

All map-only: one row per page is widened with its tag list, exploded
(``posexplode``, a codegen'd Generate right after the scan), and each
candidate reference is resolved with Column expressions. Nothing here
shuffles; at scale the links table is written partitioned by ``site``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.columns import once
from .rewrite import CSS_IMPORT_RE, CSS_URL_RE

_CAND_TYPE = "array<struct<pair:int,attr:string,item:int,value:string>>"
LINK_COLUMNS = ["src_url", "dst_url", "site", "tag", "attr", "pos", "pair", "item"]


def _lookup(names, raws, name: str):
    i = F.array_position(names, name)
    return F.when(i > 0, H.decode_entities(H.unquote(F.element_at(raws, i.cast("int")))))


def _page_frame(captures: DataFrame, url_col: str = "url") -> DataFrame:
    """Parsed page URL (`_u`) and its type; rows with unusable URLs drop out."""
    return once(captures, "_u", U.parsed(url_col)).where(F.col("_u").isNotNull())


def html_pages(captures: DataFrame) -> DataFrame:
    """Captures whose resource type is ``page`` (by media type, then path)."""
    df = _page_frame(captures)
    return df.where(U.classify_resource(F.col("content_type"), F.col("_u.path")) == "page")


def _tag_rows(pages: DataFrame, body_col: str, use_base: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    clean = H.blank_markup(F.col(body_col))
    df = once(pages, "_clean", clean).withColumn("_hosts", U.hosts_in(body_col))
    tags = F.zip_with(H.tag_names(F.col("_clean")), H.tag_attrs(F.col("_clean")),
                      lambda n, a: U.nstruct(name=F.lower(n), attrs=a))
    df = once(df, "_tags", tags)  # posexplode drops empty lists by a filter, which would scan again
    if use_base:
        first_base = F.element_at(
            F.filter(F.transform(F.col("_tags"),
                                 lambda t: F.when(t["name"] == "base", H.attr_value(t["attrs"], "href"))),
                     lambda x: x.isNotNull()), 1)
        base = F.when(F.col("_clean").rlike("(?i)<base[\\s/>]"),
                      F.coalesce(U.resolve(F.col("_u"), first_base, F.col("_hosts")), F.col("_u"))).otherwise(F.col("_u"))
    else:
        base = F.col("_u")
    return (df.select(U.serialize(F.col("_u")).alias("src_url"),
                      U.site_of(F.col("_u.host")).alias("site"),
                      F.col("_u.host").alias("_host"),
                      base.alias("_base"), "_hosts", *carry,
                      F.posexplode("_tags").alias("pos", "_t"))
            .where(F.col("_t.name") != "base")
            .select("src_url", "site", "_host", "_base", "_hosts", *carry, "pos",
                    F.col("_t.name").alias("tag"),
                    F.regexp_extract_all(F.lower(F.col("_t.attrs")), U.lit_re(H.ATTR_RE), 1).alias("_names"),
                    F.regexp_extract_all(F.col("_t.attrs"), U.lit_re(H.ATTR_RE), 2).alias("_raws")))


def _srcset_item(idx: int, attr: str):
    def make(p, k):
        return U.nstruct(pair=F.lit(idx), attr=F.lit(attr), item=k,
                         value=F.regexp_extract(U.trim_ws(p), f"^([^{U.WS}]+)", 1))
    return make


def _vcol(a: str) -> str:
    return "_v_" + a.replace("-", "_")


def _candidates(pairs, srcset_pairs) -> F.Column:
    tag = F.col("tag")
    values = {a: F.col(_vcol(a)) for a in {a for _, a in pairs + srcset_pairs}}
    single = [F.when(tag == t, U.nstruct(pair=F.lit(i), attr=F.lit(a), item=F.lit(0), value=values[a]))
              for i, (t, a) in enumerate(pairs)]
    out = F.array(*single)
    for j, (t, a) in enumerate(srcset_pairs):
        idx = len(pairs) + j
        parts = F.split(values[a], ",")
        items = F.transform(parts, _srcset_item(idx, a))
        items = F.filter(items, lambda x: x["value"] != "")
        out = F.concat(out, F.when((tag == t) & values[a].isNotNull(), items)
                       .otherwise(F.array().cast(_CAND_TYPE)))
    return out


def _links_from_tags(tags: DataFrame, pairs, srcset_pairs, carry: tuple[str, ...] = ()) -> DataFrame:
    wanted = sorted({t for t, _ in pairs + srcset_pairs})
    tags = tags.where(F.col("tag").isin(*wanted))
    for a in sorted({a for _, a in pairs + srcset_pairs}):
        tags = tags.withColumn(_vcol(a), _lookup(F.col("_names"), F.col("_raws"), a))
    cands = (tags
             .select("src_url", "site", "_host", "_base", "_hosts", *carry, "pos", "tag",
                     F.explode(_candidates(pairs, srcset_pairs)).alias("_c"))
             .where(F.col("_c").isNotNull() & F.col("_c.value").isNotNull()))
    resolved = once(cands, "_dst", U.resolve_link(F.col("_base"), F.col("_c.value"), F.col("_hosts")))
    return (resolved
            .where(F.col("_dst").isNotNull() & U.same_site(F.col("_dst.host"), F.col("_host")))
            .select("src_url", U.serialize(F.col("_dst")).alias("dst_url"), "site", "tag",
                    F.col("_c.attr").alias("attr"), F.col("pos").cast("int").alias("pos"),
                    F.col("_c.pair").cast("int").alias("pair"), F.col("_c.item").cast("int").alias("item"), *carry))


def extract_links(captures: DataFrame, body_col: str = "body", carry: tuple[str, ...] = ()) -> DataFrame:
    """Same-site links of every HTML capture: the 13 tag/attribute pairs plus
    srcset candidates, resolved against <base href> when present. Order inside
    a page is (pair, pos, item); duplicates are kept. ``carry``: columns of the
    captures to keep beside each link."""
    tags = _tag_rows(html_pages(captures), body_col, True, carry)
    return _links_from_tags(tags, H.LINK_PAIRS, H.SRCSET_PAIRS, carry)


def extract_srcset(captures: DataFrame, body_col: str = "body") -> DataFrame:
    """Only the srcset candidates of img/source elements."""
    tags = _tag_rows(html_pages(captures), body_col, use_base=True)
    return _links_from_tags(tags, (), H.SRCSET_PAIRS)


def extract_nav_links(rendered: DataFrame) -> DataFrame:
    """Navigation links of rendered HTML: a/area href only, resolved against
    the final URL, <base> ignored."""
    pages = _page_frame(rendered, "final_url")
    tags = _tag_rows(pages, "html", use_base=False)
    return _links_from_tags(tags, H.NAV_PAIRS, ())


def extract_css_refs(captures: DataFrame) -> DataFrame:
    """url(...) references (data: skipped) then @import targets of every CSS
    capture, resolved against the stylesheet URL, same-site only."""
    css = _page_frame(captures).where(
        U.classify_resource(F.col("content_type"), F.col("_u.path")) == "css")
    base = css.select(U.serialize(F.col("_u")).alias("src_url"),
                      U.site_of(F.col("_u.host")).alias("site"),
                      F.col("_u").alias("_base"), F.col("_u.host").alias("_host"), U.hosts_in("body").alias("_hosts"),
                      F.regexp_extract_all(F.col("body"), U.lit_re(CSS_URL_RE), 1).alias("_urls"),
                      F.regexp_extract_all(F.col("body"), U.lit_re(CSS_IMPORT_RE), 1).alias("_imports"))
    refs = base.select(
        "src_url", "site", "_base", "_host", "_hosts",
        F.explode(F.concat(
            F.transform("_urls", lambda v, i: U.nstruct(attr=F.lit("url"), pos=i, value=v)),
            F.transform("_imports", lambda v, i: U.nstruct(attr=F.lit("import"), pos=i, value=v)))).alias("_c"))
    refs = refs.where((F.col("_c.value") != "") & ~F.col("_c.value").startswith("data:"))
    resolved = once(refs, "_dst", U.resolve_link(F.col("_base"), F.col("_c.value"), F.col("_hosts")))
    return (resolved.where(F.col("_dst").isNotNull() & U.same_site(F.col("_dst.host"), F.col("_host")))
            .select("src_url", U.serialize(F.col("_dst")).alias("dst_url"), "site",
                    F.col("_c.attr").alias("attr"), F.col("_c.pos").cast("int").alias("pos")))


def rendered_requests(rendered: DataFrame) -> DataFrame:
    """URLs a renderer requested for each page: parsed (failures dropped),
    fragment removed, first occurrence kept, same-site only, and the page's
    own URL left out. Order-preserving ``array_distinct`` keeps it map-only."""
    pages = _page_frame(rendered, "final_url")
    canon = F.transform(F.col("requested_urls"), lambda r: U.normalize_url(r))
    df = pages.select(U.serialize(F.col("_u")).alias("src_url"),
                      U.site_of(F.col("_u.host")).alias("site"),
                      U.normalize_url(F.col("url")).alias("_req"),
                      F.array_distinct(F.filter(canon, lambda x: x.isNotNull())).alias("_all"))
    same = F.filter(F.col("_all"), lambda x: (U.site_of(F.regexp_extract(x, r"^[a-z]+://(\[[^\]]*\]|[^/:?]*)", 1))
                                              == F.col("site")))
    return (df.select("src_url", "site", "_req", F.posexplode(same).alias("pos", "dst_url"))
            .where((F.col("dst_url") != F.col("src_url")) & (F.col("dst_url") != F.coalesce(F.col("_req"), F.lit(""))))
            .select("src_url", "dst_url", "site", F.col("pos").cast("int").alias("pos")))
