"""Markup columns: tag scanning, attribute lookup, character references,
offline-breaker removal, script stripping and visible text.

The scanner is regular-expression based (no DOM): comments and the bodies of
raw-text elements are blanked first, then start tags are matched with a
quote-aware pattern, and attributes are tokenised the way an HTML tokenizer
splits them (first occurrence of a name wins). Residual gaps against a full
HTML5 tree builder are listed in the README.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import WS, let, lit_re, nstruct

# ---------------------------------------------------------------------------
# Fixed values.
# Tag/attribute pairs that carry links, in the order links are reported.
LINK_PAIRS = (
    ("a", "href"), ("link", "href"), ("area", "href"),
    ("script", "src"), ("img", "src"), ("source", "src"), ("video", "src"), ("audio", "src"),
    ("img", "data-src"), ("img", "data-lazy-src"),
    ("source", "data-src"), ("source", "data-lazy-src"),
    ("video", "poster"),
)
SRCSET_PAIRS = (("img", "srcset"), ("source", "srcset"))
NAV_PAIRS = (("a", "href"), ("area", "href"))
# Markers of framework-rendered pages (matched in lower-cased HTML).
SPA_MARKERS = ("__next_data__", "__nuxt__", "ng-version", "data-reactroot", "data-react-root",
               "data-server-rendered", "vite-plugin-pwa", "registersw", "data-v-app")
SPA_ROOT_IDS = ("root", "app", "__next", "__nuxt", "q-app", "__vue")
SPA_MOUNT_MARKERS = ('id="app"', "id='app'", 'id="root"', "id='root'", 'id="__nuxt"', "data-v-app")
SW_INLINE_WORDS = ("serviceWorker", "registerSW", "workbox")
# ---------------------------------------------------------------------------

_TAG_NAMES = sorted({t for t, _ in LINK_PAIRS + SRCSET_PAIRS} | {"base"})

# The patterns below are tokens of a left-to-right scan. Every loop is possessive
# (Java runs it without a stack frame per turn, and never goes back into it), and
# each pattern has a last branch that takes the rest of the document when a tag or
# an element does not end: by the standard nothing follows there, and what a failed
# attempt has read is not read again from the next "<". So a scan is linear.

# Attributes up to the tag's ">"; a quote counts only where a value begins.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)|[^\s>]*+))*+"
_NAME_END = r"(?=[\s/>])"


def _until(end: str) -> str:
    """Everything before the next tag that begins with ``</end``."""
    return rf"(?:[^<]++|<(?!/{end}))*+"


_RAW = ("script", "style", "textarea", "title")
# Comments and raw-text element bodies (the start tag is kept, so script@src
# still counts); an unterminated one runs to the end of the document. The first
# signs are looked at before any branch is tried.
BLANK_RE = (r"(?is)(?=<[!st])(?:<!--(?:-?+>|(?:[^-]++|-(?!->))*+(?:-->|\z))"
            + "".join(rf"|(<{n}{_NAME_END}{_ATTRS}>){_until(n + r'\s*+>')}(?:</{n}\s*+>|\z)" for n in _RAW)
            + rf"|<(?:{'|'.join(_RAW)}){_NAME_END}.*+)")
# Start tags of the link-carrying elements: group 1 name, group 2 attributes.
TAG_RE = rf"(?is)<({'|'.join(_TAG_NAMES)}){_NAME_END}({_ATTRS})>|<(?:{'|'.join(_TAG_NAMES)}){_NAME_END}.*+"
# Any start tag: group 1 the tag, group 2 its attributes, group 3 what is left behind one without end.
ANY_TAG_RE = rf"(?s)(<[A-Za-z][^\s/>]*+({_ATTRS})>)|(<[A-Za-z].*+)"
# One attribute: group 1 name, group 2 raw value (with its quotes).
ATTR_RE = r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"


def blank_markup(html: Column) -> Column:
    return F.regexp_replace(html, BLANK_RE, "$1$2$3$4")


def tag_names(clean: Column) -> Column:
    return F.regexp_extract_all(clean, lit_re(TAG_RE), 1)


def tag_attrs(clean: Column) -> Column:
    return F.regexp_extract_all(clean, lit_re(TAG_RE), 2)


def base_attrs(html: Column) -> Column:
    """The attributes of every base tag that has any, wherever it stands."""
    return F.regexp_extract_all(html, lit_re(rf"(?is)<base(?=[{WS}])({_ATTRS})>|<base(?=[{WS}]).*+"), 1)


def all_attrs(clean: Column) -> Column:
    """The attributes of every start tag."""
    return F.regexp_extract_all(clean, lit_re(ANY_TAG_RE), 2)


def unquote(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?s)^\"(.*)\"$|^'(.*)'$", "$1$2")


# Code points that a numeric reference stands for instead of itself: the C1
# range as Windows-1252 has it (those five that it lacks stay).
_C1 = "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(0x80, 0xA0))
#: Named references of the HTML standard (the standard library's table): those
#: ended by ";" and those that are also known without it.
_NAMED = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
_LEGACY = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
_LEGACY_RE = "|".join(sorted(_LEGACY, key=lambda n: (-len(n), n)))
REFERENCE_RE = (r"(&#[xX][0-9a-fA-F]++;?+|&#[0-9]++;?+|&[A-Za-z][A-Za-z0-9]*+;|&(?:" + _LEGACY_RE + r")(?![A-Za-z0-9=])|[^&]++|&)")
REFERENCE_IN_TEXT_RE = REFERENCE_RE.replace("(?![A-Za-z0-9=])", "")


def _table(values: dict[str, str]) -> Column:
    """A map literal (one constant after folding)."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _numeric(t: Column) -> Column:
    """The character of a numeric reference: total, as the standard has it."""
    hexed = t.rlike("^&#[xX]")
    digits = F.regexp_replace(F.regexp_extract(t, "^&#[xX]?([0-9a-fA-F]+)", 1), "^0+", "")
    size = F.length(digits)
    code = (F.when(hexed & (size <= 6), F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("int"))
            .when(~hexed & (size <= 7), F.concat(F.lit("0"), digits).cast("int")).otherwise(F.lit(0x110000)))

    def char(c):
        bad = (c == 0) | (c > 0x10FFFF) | ((c >= 0xD800) & (c <= 0xDFFF))
        return (F.when(bad, F.lit("\uFFFD"))
                .when((c >= 0x80) & (c <= 0x9F), F.substring(F.lit(_C1), c - 0x7F, F.lit(1)))
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0")), "UTF-32")))
    return let(code, char)


def decode_entities(v: Column, in_text: bool = False) -> Column:
    """Decode numeric and named character references once, from left to right.
    In an attribute value a legacy name without ";" stays as it is if a letter,
    a digit or "=" follows."""
    def one(t):
        name = F.regexp_extract(t, "^&([A-Za-z][A-Za-z0-9]*)", 1)
        ended = F.when(t.endswith(";"), F.element_at(_table(_NAMED), name))
        if in_text:  # the longest legacy name that it begins with, the rest as it is
            short = F.regexp_extract(t, f"^&({_LEGACY_RE})", 1)
            legacy = F.when(short != "", F.concat(F.element_at(_table(_LEGACY), short), F.substr(t, F.length(short) + 2)))
        else:
            legacy = F.when(~t.endswith(";"), F.element_at(_table(_LEGACY), name))
        return (F.when(~t.startswith("&"), t)
                .when(t.rlike("^&#(?:[0-9]|[xX][0-9a-fA-F])"), _numeric(t))
                .otherwise(F.coalesce(ended, legacy, t)))

    def run(s):
        return F.array_join(F.transform(F.regexp_extract_all(s, lit_re(REFERENCE_IN_TEXT_RE if in_text else REFERENCE_RE), 1), one), "")
    return F.when(v.contains("&"), let(v, run)).otherwise(v)


def attr_value(attrs: Column, name: str) -> Column:
    """Value of the first attribute called ``name`` (ASCII case-insensitive);
    NULL when absent, '' when present without a value."""
    def run(a):
        names = F.regexp_extract_all(F.lower(a), lit_re(ATTR_RE), 1)
        raws = F.regexp_extract_all(a, lit_re(ATTR_RE), 2)
        i = F.array_position(names, name)
        return F.when(i > 0, decode_entities(unquote(F.element_at(raws, i.cast("int")))))
    return let(attrs, run)


_SCRIPT_RE = rf"(?si)<script[^>]*+>{_until('script>')}</script>|(<script.*+)"


def strip_scripts(html: Column) -> Column:
    """Remove every <script ...>...</script> block (used for rendered pages); a
    script without end stays, and all behind it."""
    return F.when(F.lower(html).contains("<script"), F.regexp_replace(html, _SCRIPT_RE, "$1")).otherwise(html)


def visible_text(html: Column) -> Column:
    """Characters outside '<...>' (a stray '>' is dropped as well)."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*(?:>|$)", ""), ">", "")


# What marks a service-worker script by its address.
SW_SRC_RE = r"(?i)registersw|workbox|sw-?register|sw\.js"
# Link elements and whole script elements: group 1 the link's attributes, group
# 2 the script's, group 3 its body.
BREAKER_RE = (rf"(?is)<(?:link{_NAME_END}({_ATTRS})>|script{_NAME_END}({_ATTRS})>({_until(r'script\s*+>')})</script\s*+>)"
              rf"|<(?:link|script){_NAME_END}.*+")
_CROSSORIGIN_RE = rf"(?i)(?<![{WS}])[{WS}]++crossorigin(?:[{WS}]*+=[{WS}]*+(?:\"[^\"]*+\"|'[^']*+'|[^{WS}>\"']++))?+(?=[{WS}/>])"

#: Reasons for removing an element, and what is counted per document.
BREAKER_RULES = ("sw_script", "manifest_link", "modulepreload_link", "script_preload_link", "sw_inline_script")


def _breaker(block: Column) -> Column:
    """The rule by which an element goes, or NULL."""
    link, script, body = (F.regexp_extract(block, BREAKER_RE, i) for i in (1, 2, 3))
    is_link = block.rlike("(?i)^<link")

    def rule(x):
        rel, as_, src = F.lower(attr_value(x["link"], "rel")), F.lower(attr_value(x["link"], "as")), attr_value(x["script"], "src")
        inline = F.lit(False)
        for word in SW_INLINE_WORDS:
            inline = inline | x["body"].contains(word)
        return (F.when(x["is_link"], F.when(rel == "manifest", F.lit(BREAKER_RULES[1])).when(rel == "modulepreload", F.lit(BREAKER_RULES[2]))
                       .when((rel == "preload") & (as_ == "script"), F.lit(BREAKER_RULES[3])))
                .when(F.coalesce(src.rlike(SW_SRC_RE), F.lit(False)) & (F.trim(x["body"]) == ""), F.lit(BREAKER_RULES[0]))
                .when(inline, F.lit(BREAKER_RULES[4])))
    return let(nstruct(link=link, script=script, body=F.regexp_replace(body, r"[\t\n\f\r]", " "), is_link=is_link), rule)


def without_breakers(doc: Column) -> Column:
    """struct(html, removed): the document without elements that break under
    file://, and the rule of every element removed, in order."""
    def run(h):
        parts, blocks = F.split(h, BREAKER_RE), F.regexp_extract_all(h, lit_re(BREAKER_RE), 0)

        def rebuilt(rules):
            kept = F.zip_with(blocks, rules, lambda b, r: F.when(r.isNull(), b).otherwise(F.lit("")))
            whole = F.array_join(F.zip_with(parts, kept, lambda p, k: F.concat(F.coalesce(p, F.lit("")), F.coalesce(k, F.lit("")))), "")
            return nstruct(html=_without_crossorigin(whole), removed=F.array_compact(rules))
        return let(F.transform(blocks, _breaker), rebuilt)
    return let(doc, run)


def _without_crossorigin(doc: Column) -> Column:
    """crossorigin attributes removed, inside start tags only."""
    def run(h):
        parts, tags, rest = F.split(h, ANY_TAG_RE), F.regexp_extract_all(h, lit_re(ANY_TAG_RE), 1), F.regexp_extract_all(h, lit_re(ANY_TAG_RE), 3)
        clean = F.transform(tags, lambda t: F.regexp_replace(t, _CROSSORIGIN_RE, ""))
        whole = F.zip_with(F.zip_with(parts, clean, lambda p, t: F.concat(F.coalesce(p, F.lit("")), F.coalesce(t, F.lit("")))), rest,
                           lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
        return F.array_join(whole, "")
    return F.when(doc.rlike("(?i)crossorigin"), let(doc, run)).otherwise(doc)


def strip_offline_breakers(doc: Column) -> Column:
    return without_breakers(doc)["html"]
