"""Hosts of http(s) URLs as the URL standard serialises them, as Column code.

A host is an IPv6 address in brackets (compressed), an IPv4 address in any of
its number forms (dotted decimal), or a domain: percent-decoded, mapped and
composed as Unicode's compatibility processing for domain names prescribes
(non-transitional), and encoded label by label in Punycode. Hosts of plain
lower-case ASCII, nearly all, pass one pattern and nothing else.

Left out: the joiner, bidirectional and hyphen rules of label validity, the
check that an ``xn--`` label decodes, the reordering of several combining marks
on one letter, and the composition of single Hangul letters.
"""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, nstruct

# Code points that no domain holds; parameters of Punycode.
BAD_HOST_RE = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"
BASE, TMIN, TMAX, SKEW, DAMP, FIRST_BIAS, FIRST_N = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Code points that mapping drops, and those that it leaves though case folding would not.
IGNORED = "­͏᠋᠌᠍᠏​⁠⁤﻿" + "".join(map(chr, range(0xFE00, 0xFE10)))
KEPT = "ßς‌‍"

_PLAIN_RE = r"^[^\x00-\x20#%/:<>?@\[\\\]^|A-Z\x7F-\x{10FFFF}]++$"
_NUMBER_END_RE = r"(?:^|\.)(?:[0-9]+|0[xX][0-9a-fA-F]*)\.?$"
_INVALID_RE = r"[\p{Cn}\p{Co}\p{Cs}\p{Cc}\p{Zs}\p{Zl}\p{Zp}\p{Cf}&&[^‌‍]]|(?:^|\.)\p{M}|�"


@functools.cache
def _mapping() -> dict[str, str]:
    """Code points that the mapping step changes: compatibility case folding, and
    the ideographic full stop as a dot."""
    out = {c: "" for c in IGNORED}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        c = chr(code)
        if c in out or c in KEPT:
            continue
        if c == "ẞ":
            folded = "ß"
        else:
            folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c.casefold()).casefold())
        folded = folded.replace("。", ".")
        if folded != c:
            out[c] = folded
    return out


@functools.cache
def _singles() -> tuple[str, str]:
    pairs = [(k, v) for k, v in _mapping().items() if len(v) == 1]
    return "".join(k for k, _ in pairs) + IGNORED, "".join(v for _, v in pairs)


@functools.cache
def _several() -> str:
    return json.dumps({k: v for k, v in _mapping().items() if len(v) > 1}, ensure_ascii=False)


@functools.cache
def _composed() -> str:
    """Canonical pairs of a letter and a mark, and what they compose to."""
    out = {}
    for code in (*range(0xC0, 0x3100), *range(0x11000, 0x12000)):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == chr(code):
                out[pair] = chr(code)
    return json.dumps(out, ensure_ascii=False)


def _table(text: str) -> Column:
    return F.from_json(F.lit(text), "map<string,string>")


def _percent_decoded(h: Column) -> Column:
    """Bytes of %XX read as UTF-8, malformed ones as U+FFFD (which no host may hold)."""
    def byte_text(t):
        return F.when(t.rlike("^%[0-9A-Fa-f]{2}$"), F.substr(t, F.lit(2))).otherwise(F.hex(F.encode(t, "UTF-8")))
    runs = F.regexp_extract_all(h, F.lit("%[0-9A-Fa-f]{2}|[^%]++|%"), 0)
    return F.when(h.contains("%"), F.make_valid_utf8(F.unhex(F.array_join(F.transform(runs, byte_text), "")).cast("string"))).otherwise(h)


def _mapped(h: Column) -> Column:
    singles, to = _singles()
    spread = F.transform(F.split(F.translate(F.lower(h), singles, to), ""), lambda c: F.coalesce(F.element_at(_table(_several()), c), c))

    def composed(s):
        def step(acc, c):
            one = F.element_at(_table(_composed()), F.concat(F.substring(acc, -1, 1), c))
            return F.when(one.isNull(), F.concat(acc, c)).otherwise(F.concat(F.substr(acc, F.lit(1), F.length(acc) - 1), one))
        return F.when(s.rlike(r"\p{M}"), F.aggregate(F.split(s, ""), F.lit(""), step)).otherwise(s)
    return let(F.array_join(spread, ""), composed)


def _digits_of(q: Column, bias: Column) -> Column:
    """A variable-length integer in base 36 (at most 8 digits: a label is short)."""
    def step(s, k):
        t = F.greatest(F.lit(TMIN), F.least(F.lit(TMAX), k - bias))
        more = ~s["done"] & (s["q"] >= t)
        digit = F.when(more, t + F.pmod(s["q"] - t, BASE - t)).otherwise(s["q"])
        out = F.when(s["done"], s["out"]).otherwise(F.concat(s["out"], F.substring(F.lit(DIGITS), (digit + 1).cast("int"), F.lit(1))))
        return nstruct(out=out, q=F.when(more, F.floor((s["q"] - t) / (BASE - t))).otherwise(s["q"]), done=s["done"] | ~more)
    steps = F.sequence(F.lit(BASE).cast("bigint"), F.lit(8 * BASE).cast("bigint"), F.lit(BASE).cast("bigint"))
    return F.aggregate(steps, nstruct(out=F.lit(""), q=q, done=F.lit(False)), step, lambda s: s["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    most = ((BASE - TMIN) * TMAX) // 2

    def step(s, _):
        large = s["d"] > most
        return nstruct(d=F.when(large, F.floor(s["d"] / (BASE - TMIN))).otherwise(s["d"]), k=F.when(large, s["k"] + BASE).otherwise(s["k"]))
    start = let(F.when(first, F.floor(delta / DAMP)).otherwise(F.floor(delta / 2)), lambda d: d + F.floor(d / points))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), nstruct(d=start, k=F.lit(0).cast("bigint")), step,
                       lambda s: s["k"] + F.floor((BASE - TMIN + 1) * s["d"] / (s["d"] + SKEW)))


def punycode(label: Column) -> Column:
    """The Punycode of a label, without its prefix."""
    def run(points):
        basic = F.filter(points, lambda p: p < FIRST_N)
        text = F.array_join(F.transform(basic, lambda p: F.char(p)), "")
        count = F.size(basic).cast("bigint")
        begin = nstruct(out=F.when(count > 0, F.concat(text, F.lit("-"))).otherwise(F.lit("")), n=F.lit(FIRST_N).cast("bigint"),
                        delta=F.lit(0).cast("bigint"), bias=F.lit(FIRST_BIAS).cast("bigint"), h=count)

        def outer(s, m):  # the next code point, in ascending order
            def inner(t, c):
                hit = c == m
                return nstruct(
                    out=F.when(hit, F.concat(t["out"], _digits_of(t["delta"], t["bias"]))).otherwise(t["out"]), n=t["n"],
                    delta=F.when(hit, F.lit(0).cast("bigint")).when(c < m, t["delta"] + 1).otherwise(t["delta"]),
                    bias=F.when(hit, _adapted(t["delta"], t["h"] + 1, t["h"] == count)).otherwise(t["bias"]),
                    h=F.when(hit, t["h"] + 1).otherwise(t["h"]))
            at = nstruct(out=s["out"], n=m, delta=s["delta"] + (m - s["n"]) * (s["h"] + 1), bias=s["bias"], h=s["h"])
            return F.aggregate(points, at, inner, lambda t: nstruct(out=t["out"], n=t["n"] + 1, delta=t["delta"] + 1, bias=t["bias"], h=t["h"]))
        return F.aggregate(F.array_sort(F.array_distinct(F.filter(points, lambda p: p >= FIRST_N))), begin, outer, lambda s: s["out"])
    return let(F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("bigint")), run)


def _domain(h: Column) -> Column:
    """ASCII form of a domain, or NULL."""
    def encoded(s):
        labels = F.transform(F.split(s, r"\."), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x))
        ascii_ = F.when(s.rlike(r"[^\x00-\x7F]"), F.array_join(labels, ".")).otherwise(s)
        return F.when(~s.rlike(_INVALID_RE) & (s != "") & ~s.rlike(BAD_HOST_RE), ascii_)

    def mapped(s):
        return F.when(s.rlike(r"[^\x00-\x7F]"), _mapped(s)).otherwise(F.lower(s))
    return let(let(_percent_decoded(h), mapped), encoded)


def _ipv4(name: Column) -> Column:
    """Dotted decimals of a host whose last label is a number, or NULL."""
    def number(x):
        hexed, octal = x.rlike("^0[xX]"), x.rlike("^0.")
        digits = F.regexp_replace(F.when(hexed, F.substr(x, F.lit(3))).otherwise(x), "^0+", "")
        value = (
            F.when(hexed & digits.rlike("^[0-9a-fA-F]{0,8}$"), F.conv(F.concat(F.lit("0"), digits), 16, 10))
            .when(~hexed & octal & digits.rlike("^[0-7]{0,11}$"), F.conv(F.concat(F.lit("0"), digits), 8, 10))
            .when(~hexed & ~octal & x.rlike("^[0-9]+$") & digits.rlike("^[0-9]{0,10}$"), F.concat(F.lit("0"), digits)))
        return value.cast("bigint")

    def run(numbers):
        n = F.size(numbers)
        last = F.element_at(numbers, -1)
        head = F.slice(numbers, F.lit(1), n - 1)
        top = F.aggregate(head, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x)
        room = F.pow(F.lit(256), 5 - n).cast("bigint")
        good = (n <= 4) & ~F.exists(numbers, lambda x: x.isNull()) & ~F.exists(head, lambda x: x > 255) & (last < room)
        whole = top * room + last
        return F.when(good, let(whole, lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for s in (24, 16, 8, 0)])))
    return let(F.transform(F.split(F.regexp_replace(name, r"\.$", ""), r"\."), number), run)


def _ipv6(inner: Column) -> Column:
    """Compressed form of an address without its brackets, or NULL."""
    tail = r"^(.*:)(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"

    def in_hex(s):
        pair = [F.lower(F.hex(F.regexp_extract(s, tail, k).cast("bigint") * 256 + F.regexp_extract(s, tail, k + 1).cast("bigint"))) for k in (2, 4)]
        return F.when(s.rlike(tail), F.concat(F.regexp_extract(s, tail, 1), pair[0], F.lit(":"), pair[1])).otherwise(s)

    def halves(s):
        def groups(x):
            return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
        parts = F.split(s, "::")
        return nstruct(n=F.size(parts), a=groups(F.element_at(parts, 1)), b=groups(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))

    def whole(x):
        have = F.size(x["a"]) + F.size(x["b"])
        zeros = F.when(x["n"] == 2, 8 - have).otherwise(F.lit(0))
        good = ((x["n"] == 1) & (have == 8)) | ((x["n"] == 2) & (have <= 7))
        every = F.concat(x["a"], F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), x["b"])
        return F.when(good, let(every, lambda g: F.when(
            F.forall(g, lambda t: t.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda t: F.regexp_replace(t, "^0+(?=.)", "")), ":"))))

    def compressed(s):
        out = s
        for n in range(2, 9):  # the longest run of zeros that there is, the first of several
            run = rf"^(|.*?:)0(?::0){{{n - 1}}}(?:$|:(.*)$)"
            out = F.when(s.rlike(run), F.regexp_replace(F.regexp_replace(s, run, "$1::$2"), ":::+", "::")).otherwise(out)
        return out
    return let(let(let(let(F.lower(inner), in_hex), halves), whole), compressed)


def plain_host(h: Column) -> Column:
    """Whether a host is canonical as it stands: lower-case ASCII, no number."""
    return h.rlike(_PLAIN_RE) & ~h.rlike(_NUMBER_END_RE)


def canonical_host(raw: Column) -> Column:
    """The serialised host, or NULL where the standard rejects it."""
    def run(h):
        def named(d):
            return F.when(d.rlike(_NUMBER_END_RE), _ipv4(d)).otherwise(d)
        return (F.when(plain_host(h), h)
                .when(h.startswith("["), F.when(h.endswith("]"), let(_ipv6(F.regexp_replace(h, r"^\[|\]$", "")), lambda a: F.concat(F.lit("["), a, F.lit("]")))))
                .otherwise(let(_domain(h), named)))
    return let(raw, run)
