"""URL columns: parsing, reference resolution, site keys, resource typing,
offline paths and relative links.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``; no
Python runs per row. A parsed URL is a struct column
``struct<scheme, host, port, path, query>`` whose parts are already in their
serialised (lower-case host, percent-encoded, dot-segment-free) form, so
``serialize`` of it is the canonical string and the dedup key (fragments are
never kept). Intermediates are bound with ``let``, a one-element ``transform``,
which Spark interprets, so URL work runs outside whole-stage code generation;
percent-encoding and dot segments are skipped behind a cheap ``rlike`` guard.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, nstruct
from .hosts import canonical_host, plain_host

# ---------------------------------------------------------------------------
# Fixed values (they must equal the behaviour being reproduced).
# Unicode White_Space, which is what trim() and \s mean in the original rules.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Code points kept verbatim in a path / a query of an http(s) URL; every other
# code point is percent-encoded as UTF-8 (WHATWG path and special-query sets:
# C0 controls, space, " # < > ? ` { } for paths; C0, space, " # ' < > for
# queries; plus everything above 0x7E).
PATH_SAFE = r"\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E"
QUERY_SAFE = r"\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E"
# Default ports dropped from the serialised form.
DEFAULT_PORTS = {"http": 80, "https": 443}
# Reference prefixes that are never links.
SKIP_PREFIXES = ("#", "javascript:", "mailto:", "tel:", "data:", "blob:")
# Characters replaced by "_" in the query suffix of an offline path.
PATH_UNSAFE_IN_QUERY = "/\\:*?\"<>|"
# Resource types by media type and by path suffix.
JS_MEDIA_TYPES = ("application/javascript", "text/javascript", "application/x-javascript")
PAGE_SUFFIXES = (".html", ".htm", ".php")
CSS_SUFFIXES = (".css",)
JS_SUFFIXES = (".js", ".mjs")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".avif")
# ---------------------------------------------------------------------------

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_ABS_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
# Host (in brackets or up to the first colon) and port; no other form is one.
_HOST_PORT_RE = r"^(\[[^\]]*\]|[^:\[]*)(?::(.*))?$"


def lit_re(pattern: str) -> Column:
    return F.lit(pattern)


def trim_ws(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(c, rf"^[{WS}]++|(?<![{WS}])[{WS}]++\z", "")


def clean_input(c: Column) -> Column:
    """URL-parser input clean-up: strip C0/space at both ends, drop tab/CR/LF."""
    c = F.regexp_replace(c, r"^[\x00-\x20]++|(?<![\x00-\x20])[\x00-\x20]++\z", "")
    return F.regexp_replace(c, r"[\t\n\r]", "")


def percent_encode(c: Column, safe: str) -> Column:
    """Percent-encode (UTF-8) every code point outside ``safe``; '%' is kept."""
    def enc(v):
        runs = F.regexp_extract_all(v, lit_re(f"([{safe}]+|[^{safe}]+)"), 1)
        encoded = F.transform(
            runs,
            lambda t: F.when(t.rlike(f"^[{safe}]"), t).otherwise(
                F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1")),
        )
        return F.when(v.rlike(f"[^{safe}]"), F.array_join(encoded, "")).otherwise(v)
    return let(c, enc)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 / WHATWG dot-segment removal for a path starting with '/'."""
    def run(p):
        padded = F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}$"), F.concat(p, F.lit("/"))).otherwise(p)
        segs = F.split(F.regexp_replace(padded, "^/", ""), "/")
        empty = F.array().cast("array<string>")

        def step(acc, s):
            ls = F.lower(s)
            return (F.when(ls.isin(".", "%2e"), acc)
                    .when(ls.isin("..", ".%2e", "%2e.", "%2e%2e"),
                          F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
                    .otherwise(F.concat(acc, F.array(s))))

        folded = F.aggregate(segs, empty, step)
        return F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"),
                      F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(p)
    return let(path, run)


def _normal_path(raw: Column) -> Column:
    def run(p):
        return percent_encode(remove_dot_segments(F.when(p == "", F.lit("/")).otherwise(p)), PATH_SAFE)
    return let(F.regexp_replace(raw, r"\\", "/"), run)


def _normal_query(raw: Column) -> Column:
    return percent_encode(raw, QUERY_SAFE)


def _url_struct(scheme, host, port, path, query) -> Column:
    return nstruct(scheme=scheme, host=host, port=port, path=path, query=query)


def _split_absolute(s: Column) -> Column:
    """Scheme, host, port, path and query (with its "?") as they stand."""
    hp = F.regexp_replace(F.regexp_extract(s, _ABS_RE, 2), "^.*@", "")
    return let(hp, lambda a: nstruct(
        ok=s.rlike(_ABS_RE) & a.rlike(_HOST_PORT_RE), scheme=F.lower(F.regexp_extract(s, _ABS_RE, 1)),
        host=F.regexp_extract(a, _HOST_PORT_RE, 1), port=F.regexp_extract(a, _HOST_PORT_RE, 2),
        path=F.regexp_extract(s, _ABS_RE, 3), query=F.regexp_extract(s, _ABS_RE, 4)))


def _url_of(parts: Column, hosts: Column | None = None) -> Column:
    """URL struct of split parts, every part in its canonical form, or NULL.
    Canonical parts come out as they are. ``hosts``: see ``odd_hosts``."""
    def host_of(h):
        return canonical_host(h) if hosts is None else F.when(plain_host(h), h).otherwise(F.element_at(hosts, h))

    def build(p):
        scheme = p["scheme"]
        digits = F.regexp_replace(p["port"], "^0+(?=[0-9])", "")  # leading zeros say nothing
        number = F.when(digits.rlike("^[0-9]{1,5}$"), digits.cast("int"))
        default = F.when(scheme == "http", F.lit(DEFAULT_PORTS["http"])).otherwise(F.lit(DEFAULT_PORTS["https"]))
        port = F.when((p["port"] != "") & (number != default), number.cast("string"))
        valid = (p["ok"] & scheme.isin("http", "https") & (p["host"] != "")
                 & ((p["port"] == "") | (number.isNotNull() & (number <= 65535))))
        query = F.when(p["query"] != "", _normal_query(F.substr(p["query"], F.lit(2))))

        def with_host(host):
            return F.when(host.isNotNull(), _url_struct(scheme, host, port, _normal_path(p["path"]), query))
        return F.when(valid, let(host_of(p["host"]), with_host))
    return let(parts, build)


def parse_absolute(u: Column) -> Column:
    """Parse an absolute http(s) URL into the URL struct; NULL when it is not
    an http(s) URL or would be rejected by a URL parser."""
    return let(clean_input(u), lambda s: _url_of(_split_absolute(s)))


@functools.lru_cache(maxsize=256)
def _built(build, name: str, context: int) -> Column:
    return build(F.col(name))


def parsed(name: str) -> Column:
    """``parse_absolute`` of a column given by its name. The expression is built
    once per Spark context: it is the same wherever the name stands."""
    return _built(parse_absolute, name, id(SparkContext._active_spark_context))


def hosts_in(name: str) -> Column:
    """``odd_hosts`` of a column given by its name, built once."""
    return _built(odd_hosts, name, id(SparkContext._active_spark_context))


def odd_hosts(text: Column) -> Column:
    """Map of the hosts in a text's addresses that are not plain lower-case names
    to their canonical form. The analyzer takes a pass for each level of nested
    lambdas and stops after a hundred; code that is itself deeply nested looks
    such hosts up here, in a column of their own, instead of working them out."""
    after_slashes = F.regexp_extract_all(text, lit_re(r"[/\\]{2}([^/\\?#\"'\s<>)]++)"), 1)
    hosts = F.transform(F.filter(after_slashes, lambda a: ~plain_host(a)),
                        lambda a: F.regexp_extract(F.regexp_replace(a, "^.*@", ""), _HOST_PORT_RE, 1))
    odd = F.filter(F.array_distinct(hosts), lambda h: (h != "") & ~plain_host(h))
    return F.map_from_entries(F.transform(odd, lambda h: nstruct(raw=h, host=canonical_host(h))))


def resolve(base_col: Column, ref: Column, hosts: Column | None = None) -> Column:
    """Join a reference against a parsed base URL (WHATWG rules for the http(s)
    schemes). Returns the URL struct, or NULL when the result is not http(s)
    or not a valid URL. ``base`` is a URL struct column. Whatever its form, a
    reference is first split into parts, which are made canonical in one place."""
    def split_ref(r):
        scheme = F.lower(F.regexp_extract(r, _SCHEME_RE, 1))
        rest = F.regexp_replace(r, _SCHEME_RE, "")
        same = scheme == base["scheme"]
        return nstruct(scheme=scheme, rest=rest, r2=F.when(same, rest).otherwise(r), other=(scheme != "") & ~same)

    def build(x):
        r2 = x["r2"]
        authority = F.when(x["other"], F.concat(x["scheme"], F.lit("://"), x["rest"])) \
            .when(r2.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), r2))
        pp = F.regexp_extract(r2, r"^([^?#]*)", 1)
        q = F.regexp_extract(r2, r"^[^?#]*(\?[^#]*)", 1)

        def relative(pq):
            path = (F.when(pq["pp"].rlike(r"^[/\\]"), pq["pp"])
                    .when(pq["pp"] == "", base["path"])
                    .otherwise(F.concat(F.regexp_replace(base["path"], "[^/]*$", ""), pq["pp"])))
            query = (F.when(pq["q"] != "", pq["q"])
                     .when((pq["pp"] == "") & base["query"].isNotNull(), F.concat(F.lit("?"), base["query"])).otherwise(F.lit("")))
            return nstruct(ok=F.lit(True), scheme=base["scheme"], host=base["host"], port=F.coalesce(base["port"], F.lit("")), path=path, query=query)

        parts = F.when(authority.isNotNull(), let(authority, _split_absolute)).otherwise(let(nstruct(pp=pp, q=q), relative))
        return F.when((x["scheme"] == "") | x["scheme"].isin("http", "https"), _url_of(parts, hosts))

    def with_base(b):
        nonlocal base
        base = b
        return F.when(b.isNotNull(), let(let(clean_input(ref), split_ref), build))

    base = None
    return let(base_col, with_base)


def serialize(u: Column) -> Column:
    return let(u, lambda v: F.concat(
        v["scheme"], F.lit("://"), v["host"],
        F.coalesce(F.concat(F.lit(":"), v["port"]), F.lit("")),
        v["path"], F.coalesce(F.concat(F.lit("?"), v["query"]), F.lit(""))))


def normalize_url(u: Column) -> Column:
    """Canonical string of an absolute URL (fragment dropped); NULL if invalid."""
    return serialize(parse_absolute(u))


def site_of(host: Column) -> Column:
    """Site key: host without one leading 'www.'."""
    return F.regexp_replace(host, r"^www\.", "")


def same_site(host: Column, base_host: Column) -> Column:
    return F.coalesce(site_of(host) == site_of(base_host), F.lit(False))


def skip_reference(value: Column) -> Column:
    """References that are never followed (checked on the raw value)."""
    cond = F.lit(False)
    for p in SKIP_PREFIXES:
        cond = cond | value.startswith(p)
    return cond


def resolve_link(base: Column, href: Column, hosts: Column | None = None) -> Column:
    """Link resolution used by extraction: trim, drop empty/anchor/script-like
    references, keep only http(s) results."""
    h = trim_ws(href)
    return F.when((h == "") | skip_reference(h), F.lit(None)).otherwise(resolve(base, h, hosts))


def _ends_with_any(c: Column, suffixes) -> Column:
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | c.endswith(s)
    return cond


def classify_by_path(path: Column) -> Column:
    lp = F.lower(path)
    last = F.regexp_extract(lp, r"([^/]*)$", 1)
    return (F.when(_ends_with_any(lp, PAGE_SUFFIXES) | lp.endswith("/") | (lp == "")
                   | ~last.contains("."), F.lit("page"))
            .when(_ends_with_any(lp, CSS_SUFFIXES), F.lit("css"))
            .when(_ends_with_any(lp, JS_SUFFIXES), F.lit("js"))
            .when(_ends_with_any(lp, IMAGE_SUFFIXES), F.lit("image"))
            .otherwise(F.lit("other")))


def classify_resource(content_type: Column, path: Column) -> Column:
    """Resource type from the media type (parameters cut, case-sensitive), with
    the path as fall-back."""
    ct = trim_ws(F.split_part(content_type, F.lit(";"), F.lit(1)))
    return (F.when(content_type.isNull(), classify_by_path(path))
            .when(ct == "text/html", F.lit("page"))
            .when(ct == "text/css", F.lit("css"))
            .when(ct.isin(*JS_MEDIA_TYPES), F.lit("js"))
            .when(ct.startswith("image/"), F.lit("image"))
            .when(ct.startswith("font/") | ct.contains("font"), F.lit("other"))
            .otherwise(classify_by_path(path)))


def offline_path(path: Column, query: Column) -> Column:
    """Relative file path of a URL inside its site's mirror."""
    raw = F.regexp_replace(path, r"^/+", "")
    qs = F.when(query.isNotNull() & (query != ""),
                F.concat(F.lit("@"), F.translate(query, PATH_UNSAFE_IN_QUERY, "_" * len(PATH_UNSAFE_IN_QUERY)))
                ).otherwise(F.lit(""))
    last = F.regexp_extract(raw, r"([^/]*)$", 1)
    stem = F.regexp_extract(raw, r"(?s)^(.*)\.[^./]*$", 1)
    ext = F.regexp_extract(raw, r"(\.[^./]*)$", 1)
    return (F.when((raw == "") | raw.endswith("/"),
                   F.when(qs == "", F.concat(raw, F.lit("index.html")))
                   .otherwise(F.concat(raw, qs, F.lit("/index.html"))))
            .when(last.contains("."),
                  F.when(qs == "", raw).otherwise(F.concat(stem, qs, ext)))
            .otherwise(F.when(qs == "", F.concat(raw, F.lit("/index.html")))
                       .otherwise(F.concat(raw, qs, F.lit("/index.html")))))


def relative_link(page_path: Column, target_path: Column) -> Column:
    """Relative path from the directory of ``page_path`` to ``target_path``."""
    page_dir = F.regexp_extract(page_path, r"(?s)^(.*)/[^/]*$", 1)
    dirs = F.filter(F.split(page_dir, "/"), lambda x: x != "")
    tgt = F.filter(F.split(target_path, "/"), lambda x: x != "")
    eqs = F.zip_with(dirs, tgt, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_diff = F.array_position(eqs, False)
    common = F.when(first_diff == 0, F.size(eqs)).otherwise(first_diff - 1).cast("int")
    ups = F.repeat(F.lit("../"), F.size(dirs) - common)
    rest = F.array_join(F.slice(tgt, common + 1, F.greatest(F.size(tgt) - common, F.lit(0))), "/")
    result = F.concat(ups, rest)
    return (F.when((page_dir == "") & (target_path == "index.html"), target_path)
            .when(result == "", F.lit("."))
            .otherwise(result))
