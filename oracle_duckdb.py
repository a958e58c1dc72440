"""DuckDB formulations of every registered query (the correctness oracle).

Written apart from the Spark code, in DuckDB's SQL dialect (RE2 regular
expressions, ``lambda x:`` list functions), and without importing it: every
pattern, list and derived input is stated here again, so that a slip in the
engine's own shows up as a difference. Long per-row rules are a chain of CTE
stages, so that each intermediate is a column, never a repeated sub-expression.
"""

from __future__ import annotations

import html.entities

# --------------------------------------------------------------------------
# Fixed values, stated for RE2.
WS = r"\t\n\v\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATH_KEPT = r"!$-;=@-_a-z|~"
QUERY_KEPT = r"!$-&(-;=?-~"
SCHEME = r"^([A-Za-z][-+.A-Za-z0-9]*):"
ABSOLUTE = r"^([A-Za-z][-+.A-Za-z0-9]*):[/\\]*([^#/?\\]*)([^#?]*)(\?[^#]*)?(?:#.*)?$"
HOST = r"^(\[[^\]]*\]|[^:]*)"
PORT = r"^(?:\[[^\]]*\]|[^:]*):(.*)$"
BAD_HOST = r"[\x00-\x20\x7F#%/:<>?@\[\]\\^|]"
NO_LINKS = ("#", "javascript:", "mailto:", "tel:", "data:", "blob:")
QUERY_TO_FILE = '/\\:*?"<>|'
JS_TYPES = ("application/javascript", "text/javascript", "application/x-javascript")
PAGE_ENDS, CSS_ENDS, JS_ENDS = (".html", ".htm", ".php"), (".css",), (".js", ".mjs")
IMAGE_ENDS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".avif")
SINGLE = (("a", "href"), ("link", "href"), ("area", "href"), ("script", "src"), ("img", "src"), ("source", "src"), ("video", "src"), ("audio", "src"),
          ("img", "data-src"), ("img", "data-lazy-src"), ("source", "data-src"), ("source", "data-lazy-src"), ("video", "poster"))
SETS = (("img", "srcset"), ("source", "srcset"))
NAVIGATION = (("a", "href"), ("area", "href"))
IN_TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
BLANKED = (r"(?is)<!--.*?(?:-->|$)|(<script(?:[\s/][^>]*)?>).*?(?:</script\s*>|$)|(<style(?:[\s/][^>]*)?>).*?(?:</style\s*>|$)"
           r"|(<textarea(?:[\s/][^>]*)?>).*?(?:</textarea\s*>|$)|(<title(?:[\s/][^>]*)?>).*?(?:</title\s*>|$)")
TAG = r"(?i)<(a|area|audio|base|img|link|script|source|video)((?:[\s/]" + IN_TAG + r")?)>"
ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?"""
REWRITTEN = rf'(?i)[{WS}]+(href|src|action|poster|srcset)[{WS}]*=[{WS}]*"([^"]*)"'
BASE_TAG = rf"""(?i)<base[{WS}]+[^>]*href[{WS}]*=[{WS}]*["']([^"']+)["']"""
REWRITE_SIGNS = ("href=", "src=", "srcset=", "data-src")
CSS_URL = rf"""url\([{WS}]*['"]?([^'")]+)['"]?[{WS}]*\)"""
CSS_IMPORT = rf"""@import[{WS}]+['"]([^'"]+)['"]"""
FRAMEWORK_SIGNS = ("__next_data__", "__nuxt__", "ng-version", "data-reactroot", "data-react-root", "data-server-rendered", "vite-plugin-pwa", "registersw", "data-v-app")
ROOT_IDS = "root|app|__next|__nuxt|q-app|__vue"
ROOT_TAG = rf"""<[A-Za-z][^>]*[{WS}/]id[{WS}]*=[{WS}]*(?:"(?:{ROOT_IDS})"|'(?:{ROOT_IDS})'|(?:{ROOT_IDS})[{WS}/>])"""
MOUNT_SIGNS = ('id="app"', "id='app'", 'id="root"', "id='root'", 'id="__nuxt"', "data-v-app")
WORKER_WORDS = ("serviceWorker", "registerSW", "workbox")
WORKER_SRC = r"(?i)registersw|workbox|sw-?register|sw\.js"
MODES = ("auto", "on", "off", "AUTO", "Yes", "bogus")
MODES_ON, MODES_OFF = ("on", "yes", "true"), ("off", "no", "false")
ASSET_PATHS = ("/cdn-cgi/rum?x=1", "/a/__cf_bm", "/beacon/rum", "/js/cloudflareinsights.js", "/ok/app.js", "/Docs/Guide.HTML", "/docs/v1.2/")
# Derived inputs.
TYPES = ("text/html; charset=utf-8", "text/html", "text/css", "application/javascript", "image/png", "font/woff2", "application/json", None, "TEXT/HTML", "image/svg+xml")
MODIFIED = ("Mon, 01 Jan 2024 00:00:00 GMT", "", None)
ROBOTS = ("User-agent: *\nDisallow: /en/\nAllow: /en/1\n", "# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr\nDisallow:\n",
          "user-agent: *\nDisallow: /es/\nUser-agent: *\r\nAllow: /es/9\nDisallow: /es/90\n", None)
EVENT_STATUS = (("error", 503), ("click", 429), ("view", 200), ("signup", 404), ("purchase", None))


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join("NULL::VARCHAR" if v is None else q(v) for v in values) + "]"


class Stages:
    """A chain of ``SELECT *, <new columns> FROM <previous>`` CTEs."""

    def __init__(self, source_sql: str, ctes: list[tuple[str, str]] | None = None, name: str = "s"):
        self.ctes = list(ctes or [])
        self.base = name
        self.n = 0
        self._push(source_sql)

    def _push(self, sql: str) -> str:
        name = f"{self.base}{self.n}_{len(self.ctes)}"
        self.n += 1
        self.ctes.append((name, sql))
        return name

    @property
    def last(self) -> str:
        return self.ctes[-1][0]

    def add(self, **cols: str) -> "Stages":
        exprs = ", ".join(f"{e} AS {c}" for c, e in cols.items())
        self._push(f"SELECT *, {exprs} FROM {self.last}")
        return self

    def where(self, cond: str) -> "Stages":
        self._push(f"SELECT * FROM {self.last} WHERE {cond}")
        return self

    def select(self, sql_body: str) -> "Stages":
        """Replace the row set: ``sql_body`` uses ``{prev}`` for the last stage."""
        self._push(sql_body.replace("{prev}", self.last))
        return self

    def sql(self, final: str | None = None) -> str:
        body = final.replace("{prev}", self.last) if final else f"SELECT * FROM {self.last}"
        return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in self.ctes) + "\n" + body


# --------------------------------------------------------------------------
# URL rules


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(r'^[\x00-\x20]+|[\x00-\x20]+$')}, '', 'g'), {q(r'[\t\n\r]')}, '', 'g')"


def enc(c: str, safe: str) -> str:
    runs = f"regexp_extract_all({c}, {q(f'([{safe}]+|[^{safe}]+)')}, 1)"
    one = (f"lambda t: CASE WHEN regexp_matches(t, {q(f'^[{safe}]')}) THEN t "
           f"ELSE regexp_replace(hex(encode(t)), '(..)', '%\\1', 'g') END")
    return (f"CASE WHEN regexp_matches({c}, {q(f'[^{safe}]')}) "
            f"THEN array_to_string(list_transform({runs}, {one}), '') ELSE {c} END")


def dots(p: str) -> str:
    padded = f"CASE WHEN regexp_matches({p}, {q(r'(?i)/(?:\.|%2e){1,2}$')}) THEN {p} || '/' ELSE {p} END"
    segs = f"string_split(regexp_replace({padded}, '^/', ''), '/')"
    step = ("lambda acc, s: CASE WHEN lower(s) IN ('.', '%2e') THEN acc "
            "WHEN lower(s) IN ('..', '.%2e', '%2e.', '%2e%2e') THEN "
            "(CASE WHEN len(acc) > 0 THEN list_slice(acc, 1, len(acc) - 1) ELSE acc END) "
            "ELSE list_append(acc, s) END")
    folded = f"list_reduce({segs}, {step}, []::VARCHAR[])"
    return (f"CASE WHEN regexp_matches({p}, {q(r'(?i)/(?:\.|%2e){1,2}(?:/|$)')}) "
            f"THEN '/' || array_to_string({folded}, '/') ELSE {p} END")


def parse_abs(st: Stages, src: str, o: str) -> Stages:
    """Adds {o}_scheme, {o}_host, {o}_port, {o}_path, {o}_query, {o}_ok."""
    st.add(**{f"{o}_s": clean(src)})
    s = f"{o}_s"
    st.add(**{f"{o}_m": f"regexp_matches({s}, {q(ABSOLUTE)})",
              f"{o}_sch": f"lower(regexp_extract({s}, {q(ABSOLUTE)}, 1))",
              f"{o}_hp": f"regexp_replace(regexp_extract({s}, {q(ABSOLUTE)}, 2), '^.*@', '')",
              f"{o}_rp": f"regexp_extract({s}, {q(ABSOLUTE)}, 3)",
              f"{o}_rq": f"regexp_extract({s}, {q(ABSOLUTE)}, 4)"})
    st.add(**{f"{o}_h": f"lower(regexp_extract({o}_hp, {q(HOST)}, 1))",
              f"{o}_pr": f"regexp_extract({o}_hp, {q(PORT)}, 1)",
              f"{o}_p1": f"CASE WHEN replace({o}_rp, '\\', '/') = '' THEN '/' ELSE replace({o}_rp, '\\', '/') END",
              f"{o}_q1": f"CASE WHEN {o}_rq = '' THEN NULL ELSE substr({o}_rq, 2) END"})
    st.add(**{f"{o}_pn": f"CASE WHEN regexp_matches({o}_pr, '^0*[0-9]{{1,5}}$') THEN CAST({o}_pr AS BIGINT) END",
              f"{o}_p2": dots(f"{o}_p1")})
    valid = (f"coalesce({o}_m AND {o}_sch IN ('http', 'https') AND {o}_h <> '' "
             f"AND (starts_with({o}_h, '[') OR NOT regexp_matches({o}_h, {q(BAD_HOST)})) "
             f"AND ({o}_pr = '' OR ({o}_pn IS NOT NULL AND {o}_pn <= 65535)), false)")
    default = f"CASE WHEN {o}_sch = 'http' THEN 80 ELSE 443 END"
    st.add(**{f"{o}_ok": valid,
              f"{o}_port0": f"CASE WHEN {o}_pr = '' OR {o}_pn = {default} THEN NULL ELSE CAST({o}_pn AS VARCHAR) END",
              f"{o}_p3": enc(f"{o}_p2", PATH_KEPT),
              f"{o}_q3": enc(f"{o}_q1", QUERY_KEPT)})
    st.add(**{f"{o}_scheme": f"CASE WHEN {o}_ok THEN {o}_sch END",
              f"{o}_host": f"CASE WHEN {o}_ok THEN {o}_h END",
              f"{o}_port": f"CASE WHEN {o}_ok THEN {o}_port0 END",
              f"{o}_path": f"CASE WHEN {o}_ok THEN {o}_p3 END",
              f"{o}_query": f"CASE WHEN {o}_ok THEN {o}_q3 END"})
    return st


def resolve(st: Stages, b: str, ref: str, o: str) -> Stages:
    """Join reference column ``ref`` against parsed base ``{b}_*``; adds
    {o}_scheme/host/port/path/query and {o}_ok."""
    st.add(**{f"{o}_r": clean(ref)})
    st.add(**{f"{o}_hs": f"regexp_matches({o}_r, {q(SCHEME)})",
              f"{o}_sch": f"lower(regexp_extract({o}_r, {q(SCHEME)}, 1))",
              f"{o}_rest": f"regexp_replace({o}_r, {q(SCHEME)}, '')"})
    st.add(**{f"{o}_r2": f"CASE WHEN {o}_hs AND {o}_sch = {b}_scheme THEN {o}_rest ELSE {o}_r END"})
    st.add(**{f"{o}_auth": (f"CASE WHEN {o}_hs AND {o}_sch <> {b}_scheme THEN {o}_sch || '://' || {o}_rest "
                            f"WHEN regexp_matches({o}_r2, {q(r'^[/\\]{2}')}) THEN {b}_scheme || ':' || {o}_r2 END"),
              f"{o}_pp": f"regexp_extract({o}_r2, '^([^?#]*)', 1)",
              f"{o}_qq": f"regexp_extract({o}_r2, {q(r'^[^?#]*(\?[^#]*)')}, 1)"})
    st.add(**{f"{o}_np0": (f"CASE WHEN regexp_matches({o}_pp, {q(r'^[/\\]')}) THEN {o}_pp "
                           f"WHEN {o}_pp = '' THEN {b}_path "
                           f"ELSE regexp_replace({b}_path, '[^/]*$', '') || {o}_pp END"),
              f"{o}_nq0": f"CASE WHEN {o}_qq <> '' THEN substr({o}_qq, 2) END"})
    st.add(**{f"{o}_np1": f"CASE WHEN replace({o}_np0, '\\', '/') = '' THEN '/' ELSE replace({o}_np0, '\\', '/') END"})
    st.add(**{f"{o}_np2": dots(f"{o}_np1")})
    st.add(**{f"{o}_np3": enc(f"{o}_np2", PATH_KEPT), f"{o}_nq3": enc(f"{o}_nq0", QUERY_KEPT)})
    parse_abs(st, f"{o}_auth", f"{o}_a")
    kind = (f"CASE WHEN {b}_scheme IS NULL THEN 'none' "
            f"WHEN {o}_hs AND {o}_sch NOT IN ('http', 'https') THEN 'none' "
            f"WHEN {o}_auth IS NOT NULL THEN 'abs' ELSE 'rel' END")
    st.add(**{f"{o}_kind": kind})
    pick = lambda a, r: f"CASE WHEN {o}_kind = 'abs' THEN {a} WHEN {o}_kind = 'rel' THEN {r} END"
    st.add(**{f"{o}_scheme": pick(f"{o}_a_scheme", f"{b}_scheme"),
              f"{o}_host": pick(f"{o}_a_host", f"{b}_host"),
              f"{o}_port": pick(f"{o}_a_port", f"{b}_port"),
              f"{o}_path": pick(f"{o}_a_path", f"{o}_np3"),
              f"{o}_query": pick(f"{o}_a_query",
                                 f"CASE WHEN {o}_qq <> '' THEN {o}_nq3 WHEN {o}_pp = '' THEN {b}_query END")})
    st.add(**{f"{o}_ok": f"{o}_scheme IS NOT NULL"})
    return st


def serialize(o: str) -> str:
    return (f"({o}_scheme || '://' || {o}_host || coalesce(':' || {o}_port, '') || {o}_path "
            f"|| coalesce('?' || {o}_query, ''))")


def site_of(h: str) -> str:
    return f"regexp_replace({h}, '^www\\.', '')"


def skip_ref(v: str) -> str:
    return "(" + " OR ".join(f"starts_with({v}, {q(p)})" for p in NO_LINKS) + ")"


def ends_any(c: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({c}, {q(s)})" for s in suffixes) + ")"


def classify_by_path(p: str) -> str:
    lp = f"lower({p})"
    last = f"regexp_extract({lp}, '([^/]*)$', 1)"
    return (f"CASE WHEN {ends_any(lp, PAGE_ENDS)} OR ends_with({lp}, '/') OR {lp} = '' "
            f"OR NOT contains({last}, '.') THEN 'page' "
            f"WHEN {ends_any(lp, CSS_ENDS)} THEN 'css' WHEN {ends_any(lp, JS_ENDS)} THEN 'js' "
            f"WHEN {ends_any(lp, IMAGE_ENDS)} THEN 'image' ELSE 'other' END")


def classify(ct: str, p: str) -> str:
    c = trim_ws(f"split_part({ct}, ';', 1)")
    js = ", ".join(q(x) for x in JS_TYPES)
    return (f"CASE WHEN {ct} IS NULL THEN {classify_by_path(p)} "
            f"WHEN {c} = 'text/html' THEN 'page' WHEN {c} = 'text/css' THEN 'css' "
            f"WHEN {c} IN ({js}) THEN 'js' WHEN starts_with({c}, 'image/') THEN 'image' "
            f"WHEN starts_with({c}, 'font/') OR contains({c}, 'font') THEN 'other' "
            f"ELSE {classify_by_path(p)} END")


def offline_path(p: str, qr: str) -> str:
    raw = f"regexp_replace({p}, '^/+', '')"
    tr_from = QUERY_TO_FILE
    qs = (f"(CASE WHEN {qr} IS NOT NULL AND {qr} <> '' THEN '@' || translate({qr}, {q(tr_from)}, "
          f"{q('_' * len(tr_from))}) ELSE '' END)")
    last = f"regexp_extract({raw}, '([^/]*)$', 1)"
    stem = f"regexp_extract({raw}, {q(r'(?s)^(.*)\.[^./]*$')}, 1)"
    ext = f"regexp_extract({raw}, {q(r'(\.[^./]*)$')}, 1)"
    return (f"CASE WHEN {raw} = '' OR ends_with({raw}, '/') THEN "
            f"(CASE WHEN {qs} = '' THEN {raw} || 'index.html' ELSE {raw} || {qs} || '/index.html' END) "
            f"WHEN contains({last}, '.') THEN (CASE WHEN {qs} = '' THEN {raw} ELSE {stem} || {qs} || {ext} END) "
            f"ELSE (CASE WHEN {qs} = '' THEN {raw} || '/index.html' ELSE {raw} || {qs} || '/index.html' END) END")


def relative_link(st: Stages, page_path: str, target: str, o: str) -> Stages:
    st.add(**{f"{o}_dir": f"regexp_extract({page_path}, {q(r'(?s)^(.*)/[^/]*$')}, 1)"})
    st.add(**{f"{o}_dl": f"list_filter(string_split({o}_dir, '/'), lambda x: x <> '')",
              f"{o}_tl": f"list_filter(string_split({target}, '/'), lambda x: x <> '')"})
    eqs = f"list_transform(range(1, least(len({o}_dl), len({o}_tl)) + 1), lambda i: {o}_dl[i] = {o}_tl[i])"
    st.add(**{f"{o}_common": f"coalesce(list_position({eqs}, false) - 1, least(len({o}_dl), len({o}_tl)))"})
    res = (f"repeat('../', CAST(len({o}_dl) - {o}_common AS INTEGER)) || "
           f"array_to_string(list_slice({o}_tl, {o}_common + 1, len({o}_tl)), '/')")
    st.add(**{o: (f"CASE WHEN {o}_dir = '' AND {target} = 'index.html' THEN {target} "
                  f"WHEN {res} = '' THEN '.' ELSE {res} END")})
    return st


# --------------------------------------------------------------------------
# Markup rules
EMPTY = "''"
UNQUOTE_RE = r"""(?s)^"(.*)"$|^'(.*)'$"""


def unquote(raw: str) -> str:
    return f"regexp_replace({raw}, {q(UNQUOTE_RE)}, '\\1\\2')"


C1 = [chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in range(0x80, 0xA0)]
NAMED = [(k[:-1], v) for k, v in html.entities.html5.items() if k.endswith(";")]
LEGACY = [(k, v) for k, v in html.entities.html5.items() if not k.endswith(";")]


def table(pairs) -> str:
    return f"MAP({arr(k for k, _ in pairs)}, {arr(v for _, v in pairs)})"


def decode_entities(v: str, in_text: bool = False) -> str:
    """Tokens are references or what lies between; a legacy name without ';'
    counts in a value if nothing that could go on with it follows, and in text by
    its longest known beginning."""
    tokens = f"regexp_extract_all({v}, {q(r'(&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*[;=]?|[^&]+|&)')}, 1)"
    hexed = "regexp_extract(t, '^&#[xX]0*([0-9a-fA-F]*)', 1)"
    digits = "regexp_extract(t, '^&#0*([0-9]*)', 1)"
    code = (f"(CASE WHEN regexp_matches(t, '^&#[xX]') THEN (CASE WHEN length({hexed}) > 6 THEN 1114112 ELSE CAST('0x0' || {hexed} AS BIGINT) END) "
            f"ELSE (CASE WHEN length({digits}) > 7 THEN 1114112 ELSE CAST('0' || {digits} AS BIGINT) END) END)")
    number = (f"CASE WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533) "
              f"WHEN {code} BETWEEN 128 AND 159 THEN ({arr(C1)})[{code} - 127] ELSE chr(CAST({code} AS INTEGER)) END")
    name = "regexp_extract(t, '^&([A-Za-z0-9]*)', 1)"
    legacy = f"CASE WHEN NOT ends_with(t, '=') THEN {table(LEGACY)}[{name}] END"
    if in_text:
        best = f"list_sort(list_transform(list_filter({arr(k for k, _ in LEGACY)}, lambda k: starts_with({name}, k)), lambda k: {{'n': length(k), 'k': k}}))[-1]"
        legacy = f"{table(LEGACY)}[({best}).k] || substr(t, 2 + ({best}).n)"
    one = (f"lambda t: CASE WHEN NOT starts_with(t, '&') OR t = '&' THEN t WHEN regexp_matches(t, '^&#') THEN {number} "
           f"WHEN ends_with(t, ';') THEN coalesce({table(NAMED)}[{name}], {'coalesce(' + legacy + ', t)' if in_text else 't'}) "
           f"ELSE coalesce({legacy}, t) END")
    return f"CASE WHEN contains({v}, '&') THEN array_to_string(list_transform({tokens}, {one}), '') ELSE {v} END"


def attr_lookup(names: str, raws: str, name: str) -> str:
    pos = f"coalesce(list_position({names}, {q(name)}), 0)"
    return f"CASE WHEN {pos} > 0 THEN {decode_entities(unquote(f'coalesce({raws}[{pos}], {EMPTY})'))} END"


def attr_value(attrs: str, name: str) -> str:
    names = f"regexp_extract_all(lower({attrs}), {q(ATTRIBUTE)}, 1)"
    raws = f"regexp_extract_all({attrs}, {q(ATTRIBUTE)}, 2)"
    return attr_lookup(names, raws, name)


# --------------------------------------------------------------------------
# Inputs
def captures_from_pages(table: str = "pages") -> str:
    return (f"SELECT url, 200 AS status, 'text/html' AS content_type, NULL::VARCHAR AS last_modified, "
            f"html AS body, CAST(page_id AS BIGINT) AS seq FROM {table}")


def pick(values, idx: str) -> str:
    return f"({arr(values)})[({idx}) + 1]"


def mixed_captures(table: str = "pages") -> str:
    n, m = len(TYPES), len(MODIFIED)
    return (f"SELECT url, CASE WHEN page_id % 23 = 7 THEN 404 ELSE 200 END AS status, "
            f"{pick(TYPES, f'page_id % {n}')} AS content_type, "
            f"{pick(MODIFIED, f'page_id % {m}')} AS last_modified, "
            f"html AS body, CAST(page_id AS BIGINT) AS seq FROM {table}")


def enriched_pages() -> str:
    pid = "CAST(page_id AS VARCHAR)"
    extra = (f"CASE page_id % 5 "
             f"WHEN 0 THEN '<img src=\"/img/p' || {pid} || '.png\" srcset=\"/img/p' || {pid} || "
             f"'-2x.png 2x, /img/p' || {pid} || '-3x.png 3x\" crossorigin=\"anonymous\">' "
             f"WHEN 1 THEN '<base href=''/base/''><a href=rel/' || {pid} || "
             f"'?a=1&amp;b=2>x</a><img data-src=\"lazy' || {pid} || '.jpg\">' "
             f"WHEN 2 THEN '<link rel=\"stylesheet\" href=\"/css/site.css\"><link rel=\"manifest\" href=\"/m.json\">"
             f"<script src=\"/js/app.js\"></script><script src=\"/registerSW.js\"></script>"
             f"<link rel=\"modulepreload\" href=\"/js/m.js\"><video src=\"/v/' || {pid} || "
             f"'.mp4\" poster=\"/v/p.jpg\"></video>' "
             f"WHEN 3 THEN '<script>navigator.serviceWorker.register(\"/sw.js\")</script>"
             f"<source srcset=\"/s/a.webp 1x, , /s/b.webp 2x\" data-lazy-src=\"/s/c.webp\">"
             f"<area href=\"//other.example.invalid/x\"><a href=\"mailto:x@y\">m</a>' "
             f"ELSE '<link rel=\"preload\" as=\"script\" href=\"/js/p.js\"><a href=\"#top\">t</a>"
             f"<audio src=\"/a/t.mp3\"></audio>' END")
    return f"SELECT page_id, url, html || {extra} AS html FROM pages"


# --------------------------------------------------------------------------
# Link extraction
def _tag_stage(source_sql: str, body: str, url: str, use_base: bool, name: str) -> Stages:
    st = Stages(source_sql, name=name)
    parse_abs(st, url, "u")
    st.where("u_ok")
    st.add(_clean=f"regexp_replace({body}, {q(BLANKED)}, '\\1\\2\\3\\4', 'g')")
    st.add(_names=f"list_transform(regexp_extract_all(_clean, {q(TAG)}, 1), lambda x: lower(x))",
           _attrs=f"regexp_extract_all(_clean, {q(TAG)}, 2)")
    if use_base:
        first = (f"list_filter(list_transform(range(1, len(_names) + 1), lambda i: CASE WHEN _names[i] = 'base' "
                 f"THEN {attr_value('coalesce(_attrs[i], ' + EMPTY + ')', 'href')} END), lambda x: x IS NOT NULL)[1]")
        st.add(_bhref=f"CASE WHEN regexp_matches(_clean, {q('(?i)<base[\\s/>]')}) THEN {first} END")
        resolve(st, "u", "_bhref", "bb")
        for part in ("scheme", "host", "port", "path", "query"):
            st.add(**{f"b_{part}": f"CASE WHEN bb_ok THEN bb_{part} ELSE u_{part} END"})
    else:
        for part in ("scheme", "host", "port", "path", "query"):
            st.add(**{f"b_{part}": f"u_{part}"})
    keep = "b_scheme, b_host, b_port, b_path, b_query"
    st.select(f"SELECT {serialize('u')} AS src_url, {site_of('u_host')} AS site, u_host AS _host, {keep}, "
              f"i - 1 AS pos, _names[i] AS tag, coalesce(_attrs[i], {EMPTY}) AS _a "
              f"FROM (SELECT *, unnest(range(1, len(_names) + 1)) AS i FROM {{prev}}) WHERE _names[i] <> 'base'")
    st.add(_an=f"regexp_extract_all(lower(_a), {q(ATTRIBUTE)}, 1)",
           _ar=f"regexp_extract_all(_a, {q(ATTRIBUTE)}, 2)")
    return st


def _link_stage(st: Stages, pairs, srcset_pairs) -> Stages:
    wanted = sorted({t for t, _ in tuple(pairs) + tuple(srcset_pairs)})
    st.where("tag IN (" + ", ".join(q(t) for t in wanted) + ")")
    attrs = sorted({a for _, a in tuple(pairs) + tuple(srcset_pairs)})
    st.add(**{f"v_{a.replace('-', '_')}": attr_lookup("_an", "_ar", a) for a in attrs})
    pieces = []
    for i, (t, a) in enumerate(pairs):
        v = f"v_{a.replace('-', '_')}"
        pieces.append(f"CASE WHEN tag = {q(t)} THEN [{{'pair': {i}, 'attr': {q(a)}, 'item': 0, 'value': {v}}}] "
                      f"ELSE [] END")
    for j, (t, a) in enumerate(srcset_pairs):
        v = f"v_{a.replace('-', '_')}"
        idx = len(pairs) + j
        item = (f"lambda p, k: {{'pair': {idx}, 'attr': {q(a)}, 'item': k - 1, "
                f"'value': regexp_extract({trim_ws('p')}, {q(f'^([^{WS}]+)')}, 1)}}")
        pieces.append(f"CASE WHEN tag = {q(t)} AND {v} IS NOT NULL THEN "
                      f"list_filter(list_transform(string_split({v}, ','), {item}), lambda x: x.value <> '') "
                      f"ELSE [] END")
    cands = "flatten([" + ", ".join(pieces) + "])"
    st.select(f"SELECT src_url, site, _host, b_scheme, b_host, b_port, b_path, b_query, pos, tag, "
              f"unnest({cands}) AS c FROM {{prev}}")
    st.where("c.value IS NOT NULL")
    st.add(_v=trim_ws("c.value"))
    st.add(_ref=f"CASE WHEN _v = '' OR {skip_ref('_v')} THEN NULL ELSE _v END")
    resolve(st, "b", "_ref", "d")
    st.where(f"_ref IS NOT NULL AND d_ok AND {site_of('d_host')} = {site_of('_host')}")
    return st


LINK_SELECT = (f"SELECT src_url, {serialize('d')} AS dst_url, site, tag, c.attr AS attr, CAST(pos AS INTEGER) AS pos, "
               f"CAST(c.pair AS INTEGER) AS pair, CAST(c.item AS INTEGER) AS item FROM {{prev}}")


def links_sql(source_sql: str, name: str = "lk") -> Stages:
    """Same-site links of HTML captures (source has url, content_type, body)."""
    st = Stages(source_sql, name=name + "p")
    parse_abs(st, "url", "pu")
    st.where(f"pu_ok AND {classify('content_type', 'pu_path')} = 'page'")
    st2 = _tag_stage(f"SELECT url, body FROM {st.last}", "body", "url", True, name)
    st2.ctes = st.ctes + st2.ctes
    return _link_stage(st2, SINGLE, SETS)


def q_extract_links() -> str:
    src = f"SELECT * FROM ({captures_from_pages('(' + enriched_pages() + ')')}) WHERE status = 200"
    return links_sql(src).sql(LINK_SELECT)


def q_extract_srcset() -> str:
    src = f"SELECT * FROM ({captures_from_pages('(' + enriched_pages() + ')')}) WHERE status = 200"
    st = Stages(src, name="ssp")
    st2 = _tag_stage(f"SELECT url, body FROM {st.last}", "body", "url", True, "ss")
    st2.ctes = st.ctes + st2.ctes
    return _link_stage(st2, (), SETS).sql(LINK_SELECT)


def latest_sql(source_sql: str) -> str:
    """The latest of all successful captures of a URL."""
    st = Stages(f"SELECT * FROM ({source_sql}) WHERE status = 200", name="la")
    parse_abs(st, "url", "u")
    st.where("u_ok")
    return st.sql(f"SELECT url, status, content_type, last_modified, body, seq FROM {{prev}} "
                  f"QUALIFY row_number() OVER (PARTITION BY {serialize('u')} ORDER BY seq DESC) = 1")


def q_site_summary() -> str:
    caps = latest_sql(repeated(captures_from_pages()))
    st = Stages(caps, name="ty")
    parse_abs(st, "url", "u")
    typed = st.sql(f"SELECT {site_of('u_host')} AS site, {classify('content_type', 'u_path')} AS rtype, "
                   f"CAST(octet_length(encode(body)) AS BIGINT) AS size FROM {{prev}}")
    links = links_sql(caps, "sl").sql(f"SELECT site, {serialize('d')} AS dst_url FROM {{prev}}")
    return (f"WITH typed AS ({typed}), links AS ({links}), "
            f"res AS (SELECT site, count(*) FILTER (WHERE rtype = 'page') AS pages, count(*) AS resources, "
            f"CAST(sum(size) AS BIGINT) AS bytes FROM typed GROUP BY site), "
            f"pl AS (SELECT site, count(*) AS links FROM links GROUP BY site), "
            f"tg AS (SELECT site, count(*) AS distinct_targets FROM (SELECT DISTINCT site, dst_url FROM links) GROUP BY site) "
            f"SELECT res.site, pages, resources, bytes, CAST(coalesce(links, 0) AS BIGINT) AS links, "
            f"CAST(coalesce(distinct_targets, 0) AS BIGINT) AS distinct_targets "
            f"FROM res LEFT JOIN pl ON res.site = pl.site LEFT JOIN tg ON res.site = tg.site")


def q_url_dim(source: str | None = None) -> str:
    st = Stages(source or mixed_captures(), name="ud")
    parse_abs(st, "url", "u")
    st.where("u_ok")
    rows = st.sql(f"SELECT {serialize('u')} AS url, u_scheme AS scheme, u_host AS host, {site_of('u_host')} AS site, "
                  f"u_path AS path, u_query AS query, {classify('content_type', 'u_path')} AS rtype, "
                  f"{offline_path('u_path', 'u_query')} AS offline_path, seq FROM {{prev}}")
    return (f"WITH r AS ({rows}) SELECT url, arg_max(scheme, seq) AS scheme, arg_max(host, seq) AS host, "
            f"arg_max(site, seq) AS site, arg_max(path, seq) AS path, arg_max(query, seq) AS query, "
            f"arg_max(rtype, seq) AS rtype, arg_max(offline_path, seq) AS offline_path, max(seq) AS seq "
            f"FROM r GROUP BY url")


def q_path_collisions() -> str:
    return (f"WITH d AS ({q_url_dim()}) SELECT site, offline_path, count(DISTINCT url) AS n_urls, "
            f"arg_max(url, seq) AS winner FROM d GROUP BY site, offline_path HAVING count(DISTINCT url) > 1")


# --------------------------------------------------------------------------
# Rewriting
BREAKER_COUNTS = ("sw_script", "manifest_link", "modulepreload_link", "script_preload_link", "sw_inline_script")
ELEMENT = r"(?is)<(?:link((?:[\s/]" + IN_TAG + r")?)>|script((?:[\s/]" + IN_TAG + r")?)>(.*?)</script\s*>)"
START_TAG = "<[A-Za-z]" + IN_TAG + ">"
CROSSORIGIN = rf"""(?i)[{WS}]+crossorigin(?:[{WS}]*=[{WS}]*(?:"[^"]*"|'[^']*'|[^{WS}>"']+))?([{WS}/>])"""


def strip_breakers(st: Stages, col: str, o: str, key: str) -> Stages:
    """Elements one per row: each is kept or named by the rule that removes it."""
    st.add(**{f"{o}_parts": f"string_split_regex({col}, {q(ELEMENT)})", f"{o}_els": f"regexp_extract_all({col}, {q(ELEMENT)})"})
    docs = st.last
    st.select(f"SELECT {key} AS k, {o}_parts AS parts, {o}_els AS els, unnest(range(1, len({o}_parts) + 1)) AS i FROM {{prev}}")
    st.add(part="parts[i]", el="els[i]")
    st.add(link=f"regexp_extract(el, {q(ELEMENT)}, 1)", script=f"regexp_extract(el, {q(ELEMENT)}, 2)", inside=f"regexp_extract(el, {q(ELEMENT)}, 3)", is_link="el[2:5] ILIKE 'link'")
    st.add(rel=f"lower({attr_value('link', 'rel')})", as_kind=f"lower({attr_value('link', 'as')})", src=attr_value("script", "src"))
    inline = " OR ".join(f"contains(inside, {q(w)})" for w in WORKER_WORDS)
    st.add(rule=(f"CASE WHEN el IS NULL THEN NULL WHEN is_link THEN (CASE WHEN rel = 'manifest' THEN 'manifest_link' WHEN rel = 'modulepreload' THEN 'modulepreload_link' "
                 f"WHEN rel = 'preload' AND as_kind = 'script' THEN 'script_preload_link' END) "
                 f"WHEN coalesce(regexp_matches(src, {q(WORKER_SRC)}), false) AND regexp_full_match(inside, '[ \\t\\n\\f\\r]*') THEN 'sw_script' "
                 f"WHEN {inline} THEN 'sw_inline_script' END"))
    rows = st.last
    counts = ", ".join(f"count(*) FILTER (WHERE rule = {q(r)}) AS {o}_{r}" for r in BREAKER_COUNTS)
    st.select(f"SELECT d.*, r.* EXCLUDE (k) FROM {docs} d JOIN (SELECT k, string_agg(part || CASE WHEN el IS NULL OR rule IS NOT NULL THEN '' ELSE el END, '' ORDER BY i) AS {o}_0, {counts} "
              f"FROM {rows} GROUP BY k) r ON d.{key} = r.k")
    st.add(**{f"{o}_tp": f"string_split_regex({o}_0, {q(START_TAG)})", f"{o}_tt": f"regexp_extract_all({o}_0, {q(START_TAG)})"})
    clean = f"regexp_replace({o}_tt[i], {q(CROSSORIGIN)}, '\\1', 'g')"
    st.add(**{o: f"array_to_string(list_transform(range(1, len({o}_tp) + 1), lambda i: {o}_tp[i] || coalesce({clean}, '')), '')"})
    return st


def rewrite_pages_sql(source_sql: str) -> str:
    """Rewritten pages: double-quoted href/src/action/poster values and srcset
    candidates (one row each), put together again, then breakers removed."""
    st = Stages(source_sql, name="rw")
    parse_abs(st, "url", "u")
    st.where(f"u_ok AND {classify('content_type', 'u_path')} = 'page'")
    st.add(_bh=f"regexp_extract(body, {q(BASE_TAG)}, 1)")
    st.add(_bref="CASE WHEN _bh <> '' THEN _bh END")
    resolve(st, "u", "_bref", "bb")
    for part in ("scheme", "host", "port", "path", "query"):
        st.add(**{f"b_{part}": f"CASE WHEN bb_ok THEN bb_{part} ELSE u_{part} END"})
    st.add(row_key="row_number() OVER ()", page_path=offline_path("u_path", "u_query"),
           _parts=f"string_split_regex(body, {q(REWRITTEN)})", _ms=f"regexp_extract_all(body, {q(REWRITTEN)}, 0)")
    pages_cte = st.last
    keep = "row_key, page_path, b_scheme, b_host, b_port, b_path, b_query"
    st.select(f"SELECT {keep}, _parts[i] AS part, _ms[i] AS m, i FROM (SELECT *, unnest(range(1, len(_parts) + 1)) AS i FROM {{prev}})")
    st.add(m_name=f"lower(regexp_extract(m, {q(REWRITTEN)}, 1))", m_value=f"regexp_extract(m, {q(REWRITTEN)}, 2)", m_prefix=f"regexp_extract(m, {q(f'^([{WS}]+[A-Za-z]+)')}, 1)")
    cands = f"list_filter(list_transform(string_split(m_value, ','), lambda c: {trim_ws('c')}), lambda c: c <> '')"
    st.add(items=f"CASE WHEN m IS NULL THEN [''] WHEN m_name = 'srcset' THEN (CASE WHEN len({cands}) > 0 THEN {cands} ELSE [''] END) ELSE [m_value] END")
    st.select("SELECT * EXCLUDE (items), items[j] AS item, j FROM (SELECT *, unnest(range(1, len(items) + 1)) AS j FROM {prev})")
    st.add(val=f"CASE WHEN m_name = 'srcset' THEN regexp_extract(item, {q(f'^([^{WS}]+)')}, 1) ELSE item END")
    rest = f"regexp_replace(item, {q(f'^[^{WS}]+')}, '')"
    st.add(detail=f"CASE WHEN m_name = 'srcset' THEN regexp_replace({trim_ws(rest)}, {q(f'[{WS}]+')}, ' ', 'g') ELSE '' END")
    st.add(_ref=f"CASE WHEN m IS NULL OR {skip_ref('val')} THEN NULL ELSE val END")
    resolve(st, "b", "_ref", "r")
    st.add(_tgt=offline_path("r_path", "r_query"))
    relative_link(st, "page_path", "_tgt", "rel")
    st.add(_new=(f"CASE WHEN NOT coalesce(r_ok, false) OR {site_of('r_host')} <> {site_of('b_host')} THEN NULL "
                 f"WHEN rel = val OR rel = '.' OR rel = page_path THEN NULL ELSE rel END"))
    st.select("SELECT row_key, i, any_value(part) AS part, any_value(m) AS m, any_value(m_prefix) AS m_prefix, bool_or(_new IS NOT NULL) AS changed, "
              "string_agg(coalesce(_new, val) || CASE WHEN detail <> '' THEN ' ' || detail ELSE '' END, ', ' ORDER BY j) AS joined FROM {prev} GROUP BY row_key, i")
    st.add(piece="part || coalesce(CASE WHEN NOT changed THEN m ELSE m_prefix || '=\"' || joined || '\"' END, '')")
    pieces = st.last
    markers = " OR ".join(f"contains(body, {q(mk)})" for mk in REWRITE_SIGNS)
    st.select(f"SELECT p.*, CASE WHEN {markers} THEN r.rebuilt ELSE body END AS rew FROM {pages_cte} p "
              f"LEFT JOIN (SELECT row_key AS k, string_agg(piece, '' ORDER BY i) AS rebuilt FROM {pieces} GROUP BY row_key) r ON p.row_key = r.k")
    strip_breakers(st, "rew", "content", "row_key")
    return st.sql(f"SELECT {serialize('u')} AS url, {site_of('u_host')} AS site, page_path AS offline_path, content, seq, last_modified, "
                  f"CAST(octet_length(encode(body)) AS BIGINT) AS size, 'sha256:' || sha256(body) AS hash, "
                  f"CAST(octet_length(encode(content)) AS BIGINT) AS out_size, "
                  f"'sha256:' || sha256(content) AS out_hash FROM {{prev}}")


def q_rewrite_pages() -> str:
    src = captures_from_pages("(" + enriched_pages() + ")")
    return f"SELECT url, offline_path, content, size, hash, out_size, out_hash FROM ({rewrite_pages_sql(src)})"


def q_strip_offline_breakers() -> str:
    st = Stages(enriched_pages(), name="sb")
    strip_breakers(st, "html", "out", "page_id")
    counts = ", ".join(f"CAST(out_{r} AS BIGINT) AS {r}" for r in BREAKER_COUNTS)
    return st.sql(f"SELECT page_id, out AS html, CAST(length(html) - length(out) AS BIGINT) AS removed_chars, {counts} FROM {{prev}}")


def q_strip_scripts() -> str:
    return (f"SELECT page_id, CASE WHEN contains(lower(html), '<script') THEN "
            f"regexp_replace(html, {q(r'(?si)<script[^>]*>.*?</script>')}, '', 'g') ELSE html END AS html "
            f"FROM ({enriched_pages()})")


def q_visible_text() -> str:
    vt = f"regexp_replace(regexp_replace(html, {q(r'(?s)<[^>]*(?:>|$)')}, '', 'g'), '>', '', 'g')"
    return (f"SELECT page_id, {vt} AS text, CAST(length(regexp_replace({vt}, {q(f'[{WS}]')}, '', 'g')) AS BIGINT) "
            f"AS visible_chars FROM pages")


# --------------------------------------------------------------------------
# More inputs
def page_site(url: str = "url") -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')"


def robots_texts() -> str:
    n = len(ROBOTS)
    return (f"SELECT site, {pick(ROBOTS, f'length(site) % {n}')} AS body "
            f"FROM (SELECT DISTINCT {page_site()} AS site FROM pages)")


def css_captures() -> str:
    pid = "CAST(page_id AS VARCHAR)"
    hrefs = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
    body = (f"'@import ''base' || {pid} || '.css'';' || chr(10) || 'body {{ background: url(''/images/bg' || {pid} || "
            f"'.png''); }}' || chr(10) || '.x {{ background: url(\"data:image/png;base64,iVBOR=\"); }}' || chr(10) || "
            f"array_to_string(list_transform({hrefs}, lambda h: '.i {{ background: url(' || h || ') }}'), chr(10))")
    url = f"regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/css/s' || {pid} || '.css'"
    return (f"SELECT {url} AS url, 200 AS status, 'text/css' AS content_type, NULL::VARCHAR AS last_modified, "
            f"{body} AS body, CAST(page_id AS BIGINT) AS seq FROM pages")


def rendered_pages(table: str = "pages") -> str:
    origin = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
    hrefs = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
    reqs = (f"list_concat([url], list_transform({hrefs}, lambda h: {origin} || h || '#frag'), "
            f"['not a url', 'https://cdn.example.invalid/lib.js'])")
    return f"SELECT url, regexp_replace(url, '#.*$', '') AS final_url, html, {reqs} AS requested_urls FROM {table}"


def q_extract_css_refs() -> str:
    st = Stages(css_captures(), name="cr")
    parse_abs(st, "url", "u")
    st.where(f"u_ok AND {classify('content_type', 'u_path')} = 'css'")
    st.add(_urls=f"regexp_extract_all(body, {q(CSS_URL)}, 1)",
           _imps=f"regexp_extract_all(body, {q(CSS_IMPORT)}, 1)")
    st.select("SELECT *, unnest(list_concat(list_transform(_urls, lambda v, i: {'attr': 'url', 'pos': i - 1, 'value': v}), "
              "list_transform(_imps, lambda v, i: {'attr': 'import', 'pos': i - 1, 'value': v}))) AS c FROM {prev}")
    st.where("NOT starts_with(c.value, 'data:')")
    st.add(_v=trim_ws("c.value"))
    st.add(_ref=f"CASE WHEN _v = '' OR {skip_ref('_v')} THEN NULL ELSE _v END")
    resolve(st, "u", "_ref", "d")
    st.where(f"_ref IS NOT NULL AND d_ok AND {site_of('d_host')} = {site_of('u_host')}")
    return st.sql(f"SELECT {serialize('u')} AS src_url, {serialize('d')} AS dst_url, {site_of('u_host')} AS site, "
                  f"c.attr AS attr, CAST(c.pos AS INTEGER) AS pos FROM {{prev}}")


def q_extract_nav_links() -> str:
    st = _tag_stage(rendered_pages(), "html", "final_url", False, "nv")
    return _link_stage(st, NAVIGATION, ()).sql(LINK_SELECT)


def q_rendered_requests() -> str:
    return rendered_requests_sql(f"({rendered_pages()})")


def rendered_requests_sql(source: str) -> str:
    st = Stages(f"SELECT *, row_number() OVER () AS rk FROM {source}", name="rr")
    parse_abs(st, "final_url", "u")
    st.where("u_ok")
    parse_abs(st, "url", "q")
    st.select(f"SELECT {serialize('u')} AS src_url, {site_of('u_host')} AS site, "
              f"CASE WHEN q_ok THEN {serialize('q')} END AS _req, r, ri, rk FROM "
              f"(SELECT *, unnest(requested_urls) AS r, generate_subscripts(requested_urls, 1) AS ri FROM {{prev}})")
    parse_abs(st, "r", "x")
    st.where("x_ok")
    st.add(dst=serialize("x"))
    st.select("SELECT rk, src_url, site, _req, dst, min(ri) AS first FROM {prev} GROUP BY ALL")
    st.where(f"{page_site('dst')} = site")
    st.add(pos="CAST(row_number() OVER (PARTITION BY rk ORDER BY first) - 1 AS INTEGER)")
    return st.sql("SELECT src_url, dst AS dst_url, site, pos FROM {prev} "
                  "WHERE dst <> src_url AND dst <> coalesce(_req, '')")


def rendered_entries() -> str:
    strip = f"CASE WHEN contains(lower(html), '<script') THEN regexp_replace(html, {q(r'(?si)<script[^>]*>.*?</script>')}, '', 'g') ELSE html END"
    src = f"SELECT final_url AS url, 'text/html' AS content_type, NULL::VARCHAR AS last_modified, {strip} AS body, 0 AS seq FROM ({rendered_pages('(' + enriched_pages() + ')')})"
    return rewrite_pages_sql(src)


def q_rewrite_rendered() -> str:
    return (f"SELECT site, url, offline_path AS path, out_size AS size, out_hash AS hash, out_hash FROM ({rendered_entries()}) "
            f"QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY out_hash DESC) = 1")


def q_rendered_frontier() -> str:
    src = f"({rendered_pages('(' + enriched_pages() + ')')})"
    nav = _link_stage(_tag_stage(f"SELECT * FROM {src}", "html", "final_url", False, "nv"), NAVIGATION, ()).sql(f"SELECT site, {serialize('d')} AS url, d_path AS path FROM {{prev}}")
    asked = rendered_requests_sql(src)
    st = Stages(f"SELECT site, dst_url AS url FROM ({asked})", name="rf")
    parse_abs(st, "url", "u")
    asset = st.sql("SELECT site, url, u_path AS path FROM {prev}")
    noise = "starts_with(path, '/cdn-cgi/') OR contains(path, '/__cf_') OR contains(path, 'cloudflareinsights') OR ends_with(path, '/rum')"
    route = "NOT contains(regexp_extract(lower(path), '([^/]*)$', 1), '.') OR ends_with(lower(path), '.html') OR ends_with(lower(path), '.htm')"
    return (f"SELECT site, url, max(kind) AS kind FROM (SELECT site, url, 'asset' AS kind FROM ({asset}) WHERE NOT ({noise}) UNION ALL "
            f"SELECT site, url, 'route' FROM ({nav}) WHERE {route}) f WHERE NOT EXISTS (SELECT 1 FROM ({q_rewrite_rendered()}) e WHERE e.site = f.site AND e.url = f.url) GROUP BY site, url")


# --------------------------------------------------------------------------
# Robots
def rules_sql(texts: str | None = None) -> str:
    body_lines = (f"SELECT site, CAST(i - 1 AS INTEGER) AS line, {trim_ws('parts[i]')} AS text FROM "
                  f"(SELECT site, string_split(body, chr(10)) AS parts, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i "
                  f"FROM ({texts or robots_texts()}) WHERE body IS NOT NULL)")
    agent = f"CASE WHEN starts_with(text, 'User-agent:') THEN {trim_ws('substr(text, 12)')} = '*' END"
    return (f"WITH l AS (SELECT * FROM ({body_lines}) WHERE text <> '' AND NOT starts_with(text, '#')), "
            f"m AS (SELECT *, {agent} AS agent FROM l), "
            f"u AS (SELECT *, coalesce(last_value(agent IGNORE NULLS) OVER (PARTITION BY site ORDER BY line "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS universal FROM m), "
            f"r AS (SELECT site, line, CASE WHEN starts_with(text, 'Disallow:') THEN false "
            f"WHEN starts_with(text, 'Allow:') THEN true END AS allow, "
            f"CASE WHEN starts_with(text, 'Disallow:') THEN {trim_ws('substr(text, 10)')} "
            f"WHEN starts_with(text, 'Allow:') THEN {trim_ws('substr(text, 7)')} END AS prefix "
            f"FROM u WHERE agent IS NULL AND universal) "
            f"SELECT site, line, allow, prefix FROM r WHERE allow IS NOT NULL AND prefix <> ''")


def q_robots_rules() -> str:
    return rules_sql()


def q_robots_counts() -> str:
    return (f"SELECT site, count(*) FILTER (WHERE NOT allow) AS disallows, count(*) FILTER (WHERE allow) AS allows "
            f"FROM ({rules_sql()}) GROUP BY site")


def robots_filter_sql(urls_sql: str, texts: str | None = None) -> str:
    """urls_sql has site, url, path; adds allowed."""
    return (f"WITH u AS ({urls_sql}), r AS ({rules_sql(texts)}), "
            f"m AS (SELECT u.site, u.url, max(CASE WHEN NOT r.allow THEN octet_length(encode(r.prefix)) END) AS d, "
            f"max(CASE WHEN r.allow THEN octet_length(encode(r.prefix)) END) AS a FROM u JOIN r ON u.site = r.site "
            f"AND starts_with(u.path, r.prefix) GROUP BY u.site, u.url) "
            f"SELECT u.*, (coalesce(m.d, 0) = 0 OR coalesce(m.a, -1) >= coalesce(m.d, 0)) AS allowed "
            f"FROM u LEFT JOIN m ON u.site = m.site AND u.url = m.url")


def page_urls_sql() -> str:
    return f"SELECT site, url, path FROM ({q_url_dim(captures_from_pages())})"


def q_robots_filter() -> str:
    return robots_filter_sql(page_urls_sql())


def asset_candidates() -> str:
    st = Stages("SELECT url FROM pages", name="ac")
    parse_abs(st, "url", "u")
    st.where("u_ok")
    return st.sql(f"SELECT {site_of('u_host')} AS site, u_host AS host, unnest(list_concat([u_path], {arr(ASSET_PATHS)})) AS path FROM {{prev}}")


def q_noise_filter() -> str:
    cond = ("starts_with(path, '/cdn-cgi/') OR contains(path, '/__cf_') OR contains(path, 'cloudflareinsights') "
            "OR ends_with(path, '/rum')")
    return f"SELECT * FROM ({asset_candidates()}) WHERE NOT ({cond})"


def q_route_filter() -> str:
    last = "regexp_extract(lower(path), '([^/]*)$', 1)"
    return (f"SELECT * FROM ({asset_candidates()}) WHERE NOT contains({last}, '.') "
            f"OR ends_with(lower(path), '.html') OR ends_with(lower(path), '.htm')")


# --------------------------------------------------------------------------
# Graph
def plain_links(where: str = "TRUE", name: str = "pl") -> str:
    src = f"SELECT * FROM ({captures_from_pages(f'(SELECT * FROM pages WHERE {where})')}) WHERE status = 200"
    return links_sql(src, name).sql(f"SELECT site, {serialize('d')} AS url, tag FROM {{prev}}")


def old_visited() -> str:
    st = Stages("SELECT * FROM pages", name="gv")
    parse_abs(st, "url", "u")
    gone = st.sql(f"SELECT {site_of('u_host')} AS site, 'https://' || u_host || '/gone/' || CAST(page_id AS VARCHAR) AS url FROM {{prev}}")
    return f"SELECT site, url FROM ({plain_links('page_id % 4 = 0', 'ov')}) UNION ALL SELECT site, url FROM ({gone})"


def q_frontier() -> str:
    return (f"SELECT DISTINCT site, url FROM ({plain_links()}) l WHERE NOT EXISTS "
            f"(SELECT 1 FROM ({old_visited()}) v WHERE v.site = l.site AND v.url = l.url)")


def q_visited_union() -> str:
    return (f"SELECT site, url FROM ({old_visited()}) UNION "
            f"SELECT site, url FROM ({plain_links()})")


def q_asset_dedupe() -> str:
    src = f"SELECT * FROM ({captures_from_pages('(' + enriched_pages() + ')')}) WHERE status = 200"
    l = links_sql(src, "ad").sql(f"SELECT site, {serialize('d')} AS url, tag FROM {{prev}}")
    return f"SELECT DISTINCT site, url FROM ({l}) WHERE tag <> 'a'"


def q_reachable() -> str:
    edges = ("SELECT s.url AS src_url, d.url AS dst_url FROM "
             "(SELECT page_id, url, unnest([(page_id * 7 + 1) % (SELECT count(*) FROM pages), "
             "(page_id * 3 + 2) % (SELECT count(*) FROM pages)]) AS dst_id FROM pages) s "
             "JOIN pages d ON d.page_id = s.dst_id")
    return (f"WITH RECURSIVE e AS ({edges}), r(url, depth) AS ("
            f"SELECT url, 0 FROM pages WHERE page_id = 0 UNION "
            f"SELECT e.dst_url, r.depth + 1 FROM r JOIN e ON r.url = e.src_url "
            f"WHERE r.depth < (SELECT count(*) FROM pages)) "
            f"SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY url")


# --------------------------------------------------------------------------
# Manifest, statistics, fetch log, features
def repeated(source_sql: str) -> str:
    bare = "regexp_replace(url, '^(https?://)www[.]', '\\1')"
    twin = f"CASE WHEN {bare} <> url THEN {bare} ELSE regexp_replace(url, '^(https?://)', '\\1www.') END"
    return (f"SELECT * FROM ({source_sql}) UNION ALL "
            f"SELECT url, status, content_type, last_modified, body || '<p>again</p>', seq + 1000000000 FROM ({source_sql}) WHERE seq % 13 = 0 UNION ALL "
            f"SELECT {twin}, status, content_type, last_modified, body, seq + 2000000000 FROM ({source_sql}) WHERE seq % 17 = 0")


def mirror_plain_sql(source: str | None = None) -> str:
    """Mirror rows (every capture): all of the inputs are pages."""
    return f"SELECT *, 'page' AS rtype FROM ({rewrite_pages_sql(source or repeated(captures_from_pages()))})"


def entries_sql(source: str | None = None) -> str:
    return (f"SELECT site, url, offline_path AS path, size, hash, last_modified AS mtime, rtype, out_hash, seq FROM ({mirror_plain_sql(source)}) "
            f"QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY seq DESC, out_hash DESC) = 1")


def files_sql(source: str | None = None) -> str:
    return (f"SELECT site, offline_path AS path, url, content, seq FROM ({mirror_plain_sql(source)}) "
            f"QUALIFY row_number() OVER (PARTITION BY site, offline_path ORDER BY seq DESC, url DESC) = 1")


def q_manifest_record() -> str:
    return entries_sql()


def q_write_manifest() -> str:
    return entries_sql(captures_from_pages())


def q_read_manifest() -> str:
    return entries_sql()


def q_manifest_lookup() -> str:
    return (f"SELECT l.site, l.url, e.rtype, e.path FROM (SELECT DISTINCT site, url FROM ({plain_links()})) l "
            f"LEFT JOIN ({entries_sql()}) e ON l.site = e.site AND l.url = e.url")


def q_manifest_init() -> str:
    return (f"SELECT site, 1 AS version, seed_url AS start_url, CASE WHEN length(site) % 2 = 0 THEN '1700000000' ELSE '1800000000' END AS created_at, "
            f"'1800000000' AS updated_at FROM ({seeds_sql()})")


def q_mirror_roundtrip() -> str:
    return (f"SELECT e.site, e.url, e.path, coalesce('sha256:' || sha256(f.content) = e.out_hash, false) AS fresh FROM ({entries_sql()}) e "
            f"LEFT JOIN ({files_sql()}) f ON e.site = f.site AND e.path = f.path")


def q_mirror_tree() -> str:
    return (f"SELECT e.site, e.url, e.path, CAST(octet_length(encode(f.content)) AS BIGINT) AS disk_size, "
            f"coalesce('sha256:' || sha256(f.content) = e.out_hash, false) AS fresh FROM ({entries_sql()}) e "
            f"LEFT JOIN ({files_sql(captures_from_pages())}) f ON e.site = f.site AND e.path = f.path")


def q_content_hash() -> str:
    return ("SELECT doc_id, 'sha256:' || sha256(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size "
            "FROM documents")


def disk_files_sql() -> str:
    return f"SELECT site, path, CASE WHEN seq % 7 = 0 THEN content || 'x' ELSE content END AS content FROM ({files_sql()}) WHERE seq % 11 <> 0"


def freshness_sql() -> str:
    return (f"SELECT e.site, e.url, e.path, e.out_hash, e.rtype, coalesce('sha256:' || sha256(f.content) = e.out_hash, false) "
            f"AS fresh FROM ({entries_sql()}) e LEFT JOIN ({disk_files_sql()}) f ON e.site = f.site AND e.path = f.path")


def q_freshness() -> str:
    return f"SELECT site, url, path, out_hash, fresh FROM ({freshness_sql()})"


def plan_sql() -> str:
    disc = (f"SELECT DISTINCT site, url FROM (SELECT site, url FROM ({plain_links()}) "
            f"UNION ALL SELECT site, url FROM ({page_urls_sql()}))")
    st = Stages(disc, name="pd")
    parse_abs(st, "url", "u")
    durls = st.sql("SELECT site, url, u_path AS path FROM {prev}")
    allowed = robots_filter_sql(durls)
    return (f"WITH d AS ({disc}), v AS (SELECT DISTINCT site, url FROM ({old_visited()})), "
            f"f AS ({freshness_sql()}), a AS ({allowed}) "
            f"SELECT d.site, d.url, CASE WHEN v.url IS NOT NULL THEN 'visited' WHEN coalesce(f.fresh, false) THEN 'fresh' "
            f"WHEN NOT coalesce(a.allowed, true) THEN 'robots' ELSE 'fetch' END AS decision, "
            f"CASE WHEN f.fresh THEN f.rtype END AS rtype, coalesce(f.fresh, false) AS fresh "
            f"FROM d LEFT JOIN v ON d.site = v.site AND d.url = v.url "
            f"LEFT JOIN f ON d.site = f.site AND d.url = f.url LEFT JOIN a ON d.site = a.site AND d.url = a.url")


def q_plan_incremental() -> str:
    return plan_sql()


def stats_sql(rows_sql: str) -> str:
    """rows: site, rtype, size, err."""
    k = 1024
    fmt = (f"CASE WHEN total_bytes <= {k} THEN CAST(total_bytes AS VARCHAR) || ' B' ELSE "
           f"(SELECT CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || ' ' || "
           f"(['B', 'KB', 'MB', 'GB'])[unit + 1] FROM (SELECT unit, "
           f"CAST(qq + CASE WHEN rr * 2 > dd OR (rr * 2 = dd AND qq % 2 = 1) THEN 1 ELSE 0 END AS HUGEINT) AS t "
           f"FROM (SELECT unit, dd, (CAST(total_bytes AS HUGEINT) * 10) // dd AS qq, "
           f"(CAST(total_bytes AS HUGEINT) * 10) % dd AS rr FROM (SELECT unit, "
           f"CAST(power(1024, unit) AS HUGEINT) AS dd FROM (SELECT CASE WHEN total_bytes <= {k * k} THEN 1 "
           f"WHEN total_bytes <= {k ** 3} THEN 2 ELSE 3 END AS unit))))) END")
    return (f"SELECT *, {fmt} AS size_text FROM (SELECT site, count(*) FILTER (WHERE rtype = 'page') AS pages, "
            f"count(*) FILTER (WHERE rtype = 'image') AS images, count(*) FILTER (WHERE rtype = 'css') AS css, "
            f"count(*) FILTER (WHERE rtype = 'js') AS js, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes, "
            f"CAST(sum(err) AS BIGINT) AS errors FROM ({rows_sql}) GROUP BY site)")


def saved_sizes(source: str) -> str:
    st = Stages(f"SELECT * FROM ({source}) WHERE status = 200", name="ss")
    parse_abs(st, "url", "u")
    st.where("u_ok")
    return st.sql(f"SELECT {serialize('u')} AS url, {site_of('u_host')} AS site, {classify('content_type', 'u_path')} AS rtype, "
                  f"CAST(octet_length(encode(body)) AS BIGINT) AS size FROM {{prev}} QUALIFY row_number() OVER (PARTITION BY {serialize('u')} ORDER BY seq DESC) = 1")


def q_site_stats() -> str:
    source = repeated(mixed_captures())
    st2 = Stages(f"SELECT * FROM ({source}) WHERE status <> 200", name="se")
    parse_abs(st2, "url", "u")
    errs = st2.sql(f"SELECT {site_of('u_host')} AS site FROM {{prev}}")
    return stats_sql(f"SELECT site, rtype, size, 0 AS err FROM ({saved_sizes(source)}) UNION ALL SELECT site, NULL, 0, 1 FROM ({errs})")


def q_run_stats() -> str:
    return stats_sql(f"SELECT site, rtype, size, 0 AS err FROM ({saved_sizes(mixed_captures())}) UNION ALL "
                     f"SELECT {page_site()}, NULL, 0, 1 FROM ({outcomes_sql()}) WHERE outcome IN ('failed', 'exhausted')")


def q_skipped_stats() -> str:
    plan = plan_sql()
    mirror = entries_sql()
    rows = (f"SELECT p.site, m.rtype, m.size, 0 AS err FROM ({plan}) p JOIN ({mirror}) m "
            f"ON p.site = m.site AND p.url = m.url WHERE p.decision = 'fetch' "
            f"UNION ALL SELECT site, rtype, 0, 0 FROM ({plan}) WHERE decision = 'fresh'")
    return stats_sql(rows)


def attempts_sql() -> str:
    status = "CASE event_type " + " ".join(
        f"WHEN {q(et)} THEN {('NULL' if st is None else st)}" for et, st in EVENT_STATUS) + " END"
    return (f"SELECT 'https://shop' || CAST(user_id % 5 AS VARCHAR) || '.example.com/u/' || CAST(user_id AS VARCHAR) AS url, "
            f"CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS attempt, "
            f"CAST({status} AS INTEGER) AS status FROM events")


def outcomes_sql() -> str:
    retry = "(status IS NULL OR (status >= 500 AND status <= 599) OR status = 429)"
    term = f"CASE WHEN NOT {retry} THEN attempt END"
    g = (f"SELECT url, min({term}) AS terminal, arg_min(status, {term}) AS terminal_status, count(*) AS logged "
         f"FROM ({attempts_sql()}) WHERE attempt < 3 GROUP BY url")
    used = "CASE WHEN terminal IS NOT NULL THEN terminal + 1 ELSE least(logged, 3) END"
    return (f"SELECT url, CASE WHEN terminal IS NOT NULL AND terminal_status = 200 THEN 'ok' "
            f"WHEN terminal IS NOT NULL THEN 'failed' WHEN logged >= 3 THEN 'exhausted' ELSE 'pending' END AS outcome, "
            f"terminal_status AS status, CAST({used} AS INTEGER) AS attempts, "
            f"CAST(500 * (power(2, {used} - 1) - 1) AS BIGINT) AS backoff_ms FROM ({g})")


def q_fetch_outcomes() -> str:
    return outcomes_sql()


def q_error_stats() -> str:
    return (f"SELECT {page_site()} AS site, count(*) AS errors FROM ({outcomes_sql()}) "
            f"WHERE outcome IN ('failed', 'exhausted') GROUP BY 1")


def q_format_bytes() -> str:
    rows = "SELECT event_id, CAST(event_id * event_id * 7919 + user_id AS BIGINT) AS total_bytes FROM events"
    inner = stats_sql("SELECT 'x' AS site, NULL AS rtype, 0 AS size, 0 AS err")
    fmt = inner.split(" AS size_text FROM")[0].replace("SELECT *, ", "", 1)
    return f"SELECT event_id, total_bytes AS n, {fmt} AS text FROM ({rows})"


def count_of(text: str, needle: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {q(needle)}, ''))) / {len(needle)} AS INTEGER)"


def spa_pages() -> str:
    head = "<!doctype html><html><head><title>t</title></head><body>"
    pid = "CAST(page_id AS VARCHAR)"
    return (f"SELECT page_id, url, CASE page_id % 6 WHEN 1 THEN html || '<div data-reactroot></div>' "
            f"WHEN 2 THEN {q(head + '<div id="app"></div><script type="module" src="/a.js"></script><p>')} || repeat('x', CAST(page_id * 7 % 700 AS INTEGER)) || '</p>' "
            f"WHEN 3 THEN {q(head + "<script>for(i=0;i<n;i++){}</script><script src=/b.js></script><script type='module'></script>")} || repeat('y ', CAST(page_id * 5 % 120 AS INTEGER)) "
            f"WHEN 4 THEN {q(head + '<main id=q-app></main><p>&eacute;&#8364;&ampx;')} || repeat('z', CAST(page_id % 50 AS INTEGER)) "
            f"WHEN 5 THEN {q(head + '<div id="root"></div><noscript>')} || {pid} || '</noscript>' ELSE html END AS html FROM pages")


RAW_ELEMENT = r"(?is)<(?:script|style)(?:[\s/][^>]*)?>(.*?)(?:</(?:script|style)\s*>|$)"


def body_text(st: Stages) -> None:
    """_dec: text of _nc; that of script and style elements whole."""
    seen = f"regexp_replace(regexp_replace(p, {q(r'(?s)<[^>]*(?:>|$)')}, '', 'g'), '>', '', 'g')"
    st.add(_rp=f"list_transform(string_split_regex(_nc, {q(RAW_ELEMENT)}), lambda p: {seen})", _rr=f"regexp_extract_all(_nc, {q(RAW_ELEMENT)}, 1)")
    st.add(_rp2=f"list_transform(_rp, lambda p: {decode_entities('p', True)})")
    st.add(_dec="array_to_string(list_transform(range(1, len(_rp2) + 1), lambda i: _rp2[i] || coalesce(_rr[i], '')), '')")


def spa_sql() -> str:
    st = Stages(spa_pages(), name="sp")
    st.add(lo="lower(html)")
    marker = " OR ".join(f"contains(lo, {q(m)})" for m in FRAMEWORK_SIGNS)
    st.add(has_marker=f"({marker})",
           module_scripts=f"{count_of('lo', 'type=' + chr(34) + 'module' + chr(34))} + {count_of('lo', chr(39).join(['type=', 'module', '']))}",
           scripts=count_of("lo", "<script"),
           has_root_id=f"regexp_matches(regexp_replace(html, {q(BLANKED)}, '\\1\\2\\3\\4', 'g'), {q(ROOT_TAG)})",
           _body=(f"CASE WHEN regexp_matches(html, {q(f'(?i)<body[{WS}/>]')}) THEN "
                  f"regexp_extract(html, {q(rf'(?is)<body(?:[{WS}/][^>]*)?>(.*)$')}, 1) "
                  f"ELSE regexp_replace(html, {q(rf'(?is)<head(?:[{WS}/][^>]*)?>.*?</head[{WS}]*>')}, '') END"))
    st.add(_nc=f"regexp_replace(_body, {q(r'(?s)<!--.*?(?:-->|$)')}, '', 'g')")
    body_text(st)
    st.add(body_text_bytes=f"CAST(octet_length(encode({trim_ws('_dec')})) AS INTEGER)")
    st.add(spa=("has_marker OR (has_root_id AND module_scripts >= 1 AND body_text_bytes < 500) "
                "OR (scripts >= 3 AND body_text_bytes < 200 AND module_scripts >= 1)"))
    return st.sql("SELECT page_id, html, has_marker, module_scripts, scripts, has_root_id, body_text_bytes, spa "
                  "FROM {prev}")


def q_spa_features() -> str:
    return ("SELECT page_id, has_marker, module_scripts, scripts, has_root_id, body_text_bytes, spa "
            f"FROM ({spa_sql()})")


def q_spa_shell() -> str:
    mount = " OR ".join(f"contains(lower(html), {q(m)})" for m in MOUNT_SIGNS)
    vt = f"regexp_replace(regexp_replace(lower(html), {q(r'(?s)<[^>]*(?:>|$)')}, '', 'g'), '>', '', 'g')"
    return (f"SELECT page_id, (({mount}) AND contains(lower(html), '<script') AND "
            f"length(regexp_replace({vt}, {q(f'[{WS}]')}, '', 'g')) < 200) AS shell FROM ({spa_pages()})")


def seeds_sql() -> str:
    first = f"SELECT {page_site()} AS site, arg_min(url, page_id) AS seed_url FROM pages GROUP BY 1"
    return (f"SELECT site, seed_url, {pick(MODES, f'length(site) % {len(MODES)}')} AS mode "
            f"FROM ({first})")


def q_render_plan() -> str:
    st = Stages(latest_sql(repeated(mixed_captures('(' + spa_pages() + ')'))), name="rp")
    parse_abs(st, "url", "u")
    st.where("u_ok")
    st.add(k=serialize("u"), lo="lower(body)", html="body")
    marker = " OR ".join(f"contains(lo, {q(m)})" for m in FRAMEWORK_SIGNS)
    st.add(has_marker=f"({marker})",
           module_scripts=f"{count_of('lo', 'type=' + chr(34) + 'module' + chr(34))} + {count_of('lo', chr(39).join(['type=', 'module', '']))}",
           scripts=count_of("lo", "<script"),
           has_root_id=f"regexp_matches(regexp_replace(html, {q(BLANKED)}, '\\1\\2\\3\\4', 'g'), {q(ROOT_TAG)})",
           _body=(f"CASE WHEN regexp_matches(html, {q(f'(?i)<body[{WS}/>]')}) THEN "
                  f"regexp_extract(html, {q(rf'(?is)<body(?:[{WS}/][^>]*)?>(.*)$')}, 1) "
                  f"ELSE regexp_replace(html, {q(rf'(?is)<head(?:[{WS}/][^>]*)?>.*?</head[{WS}]*>')}, '') END"))
    st.add(_nc=f"regexp_replace(_body, {q(r'(?s)<!--.*?(?:-->|$)')}, '', 'g')")
    body_text(st)
    st.add(bt=f"octet_length(encode({trim_ws('_dec')}))")
    st.add(verdict=("has_marker OR (has_root_id AND module_scripts >= 1 AND bt < 500) "
                    "OR (scripts >= 3 AND bt < 200 AND module_scripts >= 1)"))
    feats = st.sql("SELECT k, verdict FROM {prev}")
    s2 = Stages(seeds_sql(), name="sd")
    parse_abs(s2, "seed_url", "u")
    seeds = s2.sql(f"SELECT site, seed_url, mode, CASE WHEN u_ok THEN {serialize('u')} END AS k FROM {{prev}}")
    on = ", ".join(q(x) for x in MODES_ON)
    off = ", ".join(q(x) for x in MODES_OFF)
    return (f"SELECT s.site, s.seed_url, s.mode, CASE WHEN lower(s.mode) IN ({on}) THEN true "
            f"WHEN lower(s.mode) IN ({off}) THEN false ELSE coalesce(f.verdict, false) END AS render "
            f"FROM ({seeds}) s LEFT JOIN ({feats}) f ON s.k = f.k")


def q_seeds() -> str:
    rest = "regexp_replace(url, '^https?://', '')"
    st = Stages(f"SELECT CASE page_id % 9 WHEN 0 THEN 'ftp://' || {rest} WHEN 1 THEN {rest} WHEN 2 THEN 'http:///x' WHEN 3 THEN '  HTTPS://' || {rest} "
                f"WHEN 4 THEN 'https://a b/' || {rest} WHEN 5 THEN 'mailto:' || {rest} ELSE url END AS seed_url FROM pages", name="sv")
    parse_abs(st, "seed_url", "u")
    sch = f"lower(regexp_extract({clean('seed_url')}, {q(SCHEME)}, 1))"
    reason = (f"CASE WHEN {sch} = '' THEN 'invalid url' WHEN {sch} NOT IN ('http', 'https') "
              f"THEN 'scheme must be http or https' WHEN NOT u_ok THEN 'missing or invalid host' END")
    return st.sql(f"SELECT seed_url, ({reason}) IS NULL AS ok, {reason} AS reason, u_host AS output FROM {{prev}}")


def q_bundle() -> str:
    return (f"SELECT site, count(*) AS files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes "
            f"FROM ({files_sql()}) WHERE regexp_extract(path, '([^/]*)$', 1) <> 'mirror-manifest.json' GROUP BY site")


# --------------------------------------------------------------------------
# Streaming: the final state of a replay equals the batch result.
def q_stream_visited() -> str:
    return f"SELECT DISTINCT site, url FROM ({plain_links()})"


def q_stream_stats() -> str:
    rows = f"SELECT site, rtype, size, 0 AS err FROM ({saved_sizes(repeated(captures_from_pages()))})"
    return f"SELECT site, pages, images, css, js, total_bytes FROM ({stats_sql(rows)})"


def q_stream_manifest() -> str:
    return entries_sql()


def found_sql() -> str:
    links = links_sql(f"SELECT * FROM ({repeated(captures_from_pages())}) WHERE status = 200", "fl")
    return links.sql(f"SELECT DISTINCT site, {serialize('d')} AS url FROM {{prev}}")


def q_manifest_store() -> str:
    return (f"WITH e AS ({entries_sql()}), f AS ({found_sql()}), s AS ({seeds_sql()}) "
            f"SELECT s.site, s.seed_url AS start_url, '1700000000' AS created_at, '1800000000' AS updated_at, "
            f"(SELECT count(*) FROM e WHERE e.site = s.site) AS entries, (SELECT count(DISTINCT url) FROM e WHERE e.site = s.site) AS visited, "
            f"(SELECT count(*) FROM f WHERE f.site = s.site) AS found, (SELECT max(seq) FROM e WHERE e.site = s.site) AS last_seq, "
            f"(SELECT max(out_hash) FROM e WHERE e.site = s.site) AS last_hash FROM s")


def q_incremental_rerun() -> str:
    disc = f"SELECT DISTINCT site, url FROM (SELECT site, url FROM ({entries_sql()}) UNION ALL SELECT site, url FROM ({found_sql()}))"
    st = Stages(disc, name="ir")
    parse_abs(st, "url", "u")
    allowed = robots_filter_sql(st.sql("SELECT site, url, u_path AS path FROM {prev}"))
    return (f"WITH d AS ({disc}), v AS (SELECT DISTINCT site, url FROM ({entries_sql()})), a AS ({allowed}) "
            f"SELECT d.site, d.url, CASE WHEN v.url IS NOT NULL THEN 'visited' WHEN NOT a.allowed THEN 'robots' ELSE 'fetch' END AS decision "
            f"FROM d LEFT JOIN v ON d.site = v.site AND d.url = v.url JOIN a ON d.site = a.site AND d.url = a.url")


def crawl_url(n: str) -> str:
    """A page's address by its number."""
    return (f"('https://s' || CAST(({n}) % 8 AS VARCHAR) || repeat('x', CAST(({n}) % 8 % 4 AS BIGINT)) || '.example/' || "
            f"{pick(('en', 'fr', 'es'), f'({n}) % 3')} || '/' || CAST({n} AS VARCHAR))")


def crawl_pages() -> str:
    links = " || ".join("'<a href=\"' || " + crawl_url(f"((page_id // 8) * 4 + {k}) * 8 + page_id % 8") + " || '\">n</a>'" for k in (1, 2, 3, 4))
    return f"SELECT page_id, {crawl_url('page_id')} AS url, html || {links} AS html FROM pages"


def q_check_seeds() -> str:
    st = Stages(f"SELECT row_number() OVER () AS n, seed_url, ok FROM ({q_seeds()})", name="cs")
    parse_abs(st, "seed_url", "u")
    own = st.sql(f"SELECT n, seed_url, ok, CASE WHEN ok THEN {site_of('u_host')} END AS site, "
                 f"CASE WHEN ok THEN {serialize('u')} END AS url, CASE WHEN ok THEN u_path END AS path FROM {{prev}}")
    return (f"WITH s AS MATERIALIZED ({own}), a AS ({robots_filter_sql('SELECT DISTINCT site, url, path FROM s WHERE ok')}) "
            "SELECT s.seed_url, s.ok, s.site, s.url, a.allowed FROM s LEFT JOIN a ON s.site = a.site AND s.url = a.url")


def q_crawl_rounds() -> str:
    """Breadth first over the links of saved pages, as far as robots rules allow."""
    ok = f"SELECT * FROM ({mixed_captures('(' + crawl_pages() + ')')}) WHERE status = 200"
    links = links_sql(ok, "cr").sql(f"SELECT DISTINCT src_url, {serialize('d')} AS url, site, d_path AS path FROM {{prev}}")
    allowed = robots_filter_sql("SELECT DISTINCT site, url, path FROM e", "SELECT * FROM bodies")
    bodies = f"SELECT site, {pick(ROBOTS, f'length(site) % {len(ROBOTS)}')} AS body FROM (SELECT DISTINCT {page_site()} AS site FROM ({crawl_pages()}))"
    return (f"WITH RECURSIVE bodies AS MATERIALIZED ({bodies}), e AS MATERIALIZED ({links}), a AS MATERIALIZED ({allowed}), "
            f"ok AS MATERIALIZED (SELECT url FROM ({ok})), "
            f"r(site, url, round) AS (SELECT {page_site()}, url, 0 FROM ({crawl_pages()}) WHERE page_id < 8 UNION "
            "SELECT e.site, e.url, r.round + 1 FROM r JOIN e ON r.url = e.src_url JOIN a ON a.site = e.site AND a.url = e.url "
            "WHERE a.allowed AND r.round < (SELECT count(*) FROM pages)) "
            "SELECT site, url, CAST(min(round) AS INTEGER) AS round, url IN (SELECT url FROM ok) AS saved FROM r GROUP BY site, url")


def capture_lines() -> str:
    r = "page_id % 13"
    line = (f"""'{{"url":' || CASE {r} WHEN 1 THEN 'null' WHEN 2 THEN '"no address"' WHEN 8 THEN '" "' ELSE '"' || url || '"' END || """
            f"""',"status":' || CASE {r} WHEN 3 THEN 'null' WHEN 4 THEN '404' WHEN 5 THEN '"soon"' WHEN 9 THEN '503' ELSE '200' END || """
            f"""',"seq":' || CASE {r} WHEN 6 THEN 'null' ELSE CAST(page_id AS VARCHAR) END || """
            """',"content_type":"text/html","body":"' || regexp_replace(html, '[^A-Za-z0-9<>/ ]', '', 'g')""")
    return f"SELECT CASE {r} WHEN 0 THEN {line} WHEN 7 THEN '<html>' ELSE {line} || '\"}}' END AS line FROM pages"


def checked_sql() -> str:
    """Records with the first reason not to use them, or none."""
    st = Stages(f"SELECT line, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM ({capture_lines()})", name="cl")
    st.add(bad="j IS NULL OR json_type(j, '$.status') NOT IN ('UBIGINT', 'BIGINT', 'NULL') OR json_type(j, '$.seq') NOT IN ('UBIGINT', 'BIGINT', 'NULL')",
           url="json_extract_string(j, '$.url')", status="TRY_CAST(json_extract_string(j, '$.status') AS INTEGER)",
           seq="TRY_CAST(json_extract_string(j, '$.seq') AS BIGINT)", body="json_extract_string(j, '$.body')",
           content_type="json_extract_string(j, '$.content_type')", last_modified="NULL::VARCHAR")
    parse_abs(st, "url", "u")
    reason = ("CASE WHEN bad THEN 'malformed record' WHEN trim(coalesce(url, '')) = '' THEN 'missing url' WHEN NOT coalesce(u_ok, false) THEN 'invalid url' "
              "WHEN seq IS NULL THEN 'missing seq' WHEN status IS NULL THEN 'no response' WHEN status <> 200 THEN 'status ' || CAST(status AS VARCHAR) END")
    return st.sql(f"SELECT *, {reason} AS reason, CASE WHEN NOT bad AND u_ok THEN {site_of('u_host')} END AS site FROM {{prev}}")


def q_capture_errors() -> str:
    kept = ", ".join(f"CASE WHEN NOT bad THEN {c} END AS {c}" for c in ("url", "seq", "status"))
    return f"SELECT site, {kept}, reason, CASE WHEN bad THEN line END AS record FROM ({checked_sql()}) WHERE reason IS NOT NULL"


def q_capture_totals() -> str:
    good = f"SELECT url, status, content_type, last_modified, body, seq FROM ({checked_sql()}) WHERE reason IS NULL"
    errors = f"SELECT site FROM ({checked_sql()}) WHERE reason IS NOT NULL AND site IS NOT NULL"
    return stats_sql(f"SELECT site, rtype, size, 0 AS err FROM ({saved_sizes(good)}) UNION ALL SELECT site, NULL, 0, 1 FROM ({errors})")


def q_stream_frontier() -> str:
    return q_frontier()


def q_rewrite_css() -> str:
    st = Stages(css_captures(), name="rc")
    parse_abs(st, "url", "u")
    st.where(f"u_ok AND {classify('content_type', 'u_path')} = 'css'")
    st.add(css_path=offline_path("u_path", "u_query"),
           _parts=f"string_split_regex(body, {q(CSS_URL + '|' + CSS_IMPORT)})",
           _ms=f"regexp_extract_all(body, {q(CSS_URL + '|' + CSS_IMPORT)}, 0)")
    docs = st.last
    st.select("SELECT *, unnest(range(1, len(_parts) + 1)) AS i FROM {prev}")
    st.add(m="_ms[i]", part="_parts[i]")
    st.add(imp="coalesce(starts_with(m, '@import'), false)")
    st.add(txt=(f"CASE WHEN imp THEN regexp_extract(m, {q(CSS_URL + '|' + CSS_IMPORT)}, 2) "
                f"ELSE regexp_extract(m, {q(CSS_URL + '|' + CSS_IMPORT)}, 1) END"))
    st.add(_ref=f"CASE WHEN m IS NULL OR starts_with(txt, 'data:') OR {skip_ref('txt')} THEN NULL ELSE txt END")
    resolve(st, "u", "_ref", "r")
    st.add(_tgt=offline_path("r_path", "r_query"))
    relative_link(st, "css_path", "_tgt", "rel")
    st.add(_new=(f"CASE WHEN NOT coalesce(r_ok, false) OR {site_of('r_host')} <> {site_of('u_host')} THEN NULL "
                 f"WHEN rel = txt OR rel = '.' OR rel = css_path THEN NULL ELSE rel END"))
    st.add(piece=(f"part || coalesce(CASE WHEN _new IS NULL THEN m ELSE "
                  f"(CASE WHEN imp THEN '@import ' ELSE '' END) || 'url(\"' || _new || '\")' END, '')"))
    pieces = st.last
    st.select(f"SELECT d.*, r.content FROM {docs} d JOIN (SELECT url AS k, string_agg(piece, '' ORDER BY i) "
              f"AS content FROM {pieces} GROUP BY url) r ON d.url = r.k")
    return st.sql(f"SELECT {serialize('u')} AS url, css_path AS offline_path, content FROM {{prev}}")


# What the URL standard makes of each host form (with its port), in the order of
# the forms; NULL where it rejects the address.
HOST_RESULTS = ("[::1]", "[::1]:8080", "[2001:db8::1:0:0:1]", "[1:2::6:0:0]", "[::ffff:c000:201]", None, None, None, "xn--bcher-kva.example", "xn--bcher-kva.example",
                "xn--bcher-kva.example", "xn--bcher-kva.example", "a.b.com", None, None, "xn--fa-hia.de", "xn--strae-oqa.xn--zca.de", "xn--nxasmm1c.com", "xn--r8jz45g.xn--zckzah", "xn--fiqs8s.xn--fiqs8s", "full.example",
                "xn--n3h.net", "xy.com", None, "xn---a-esxa.xn--b-1xp", "127.0.0.1", "127.0.0.1", "127.0.0.1", "127.0.0.1", "1.2.0.3", "1.2.3.4", None, None, None, None, None,
                "0.0.0.0", None, "1.2.3.4a", "www.1e3.example", "host.example", "xn--mnchen-3ya.example:443", None, "xn--bcher-kva.example", "xn--bcher-kva.xn--fiqs8s.example")


def q_host_forms() -> str:
    n = len(HOST_RESULTS)
    host = f"CASE page_id % {n} " + " ".join(f"WHEN {i} THEN {q(h)}" for i, h in enumerate(HOST_RESULTS) if h is not None) + " END"
    return (f"WITH h AS (SELECT page_id, {host} AS host FROM pages), "
            f"u AS (SELECT page_id, 'http://' || host || '/p' || page_id AS url, "
            f"regexp_replace(regexp_replace(host, ':[0-9]+$', ''), '^www[.]', '') AS bare, host FROM h) "
            f"SELECT page_id, url, CASE WHEN starts_with(host, '[') THEN regexp_extract(host, '^([[][^]]*[]])', 1) ELSE bare END AS site, "
            f"url || '/sub' AS dst_url FROM u")
