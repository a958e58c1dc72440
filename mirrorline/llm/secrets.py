"""Secret scans with a recursive decoding worklist.

Every layer of a text is scanned for the base kinds. The whole layer with its
percent escapes decoded, the whole layer with its ``\\uXXXX`` escapes decoded (of
both, the stretches that this changes), and the content of each base64 run (on one
line or wrapped, from any character on, also compressed bytes of one or several
members, whole or broken) are new layers, which are scanned in turn until no
layer is new; layers seen before end a cycle. Bytes that are no text do not end a
layer. A secret found behind escapes is reported at
the characters that stand for it, one found in base64 at the outermost run that
held it, in characters of the text.

A compressed layer that opens to more than ``WINDOW`` bytes is read as a stream,
in windows of that size that overlap, so memory is bounded and nothing is left
out: its secrets all lie at the run that held it, so a window need only hold
enough of a match to show that there is one. What is encoded inside such a layer
is opened from each window as far as that window holds it; only a match with more
than ``OVERLAP`` characters between key and value, or an inner compressed member
of more than a window, can be missed in part.

Defined cases: a null text is empty (and stays null when redacted); equal spans
of one kind are reported once; copies and repeated rows each get their own
result; an empty table gives an empty result; other columns pass through, input
columns named ``secrets`` are replaced.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from array import array
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, table

# The base kinds in their listed order, with the least length of
# the group that must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # longest runs, so the shorter ones that fail are no matches
KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
STRETCH = re.compile(r"""[A-Za-z0-9+/_.=~:"'%\\\x20\x09-\x0D-]+""")  # all characters that matches and encoded runs can hold
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"  # as it is or, as in JSON, escaped
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++)++)(={{0,2}})")
BREAK = re.compile(_BREAK)
LINE_END = re.compile(r"""[\x20\t]*(?:\r?\n|(?:\\r)?\\n|\Z)|["'`<)}\]]""")
URL_SAFE = str.maketrans("-_", "+/")
GZIP = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
WINDOW = 16 << 20
OVERLAP = 1 << 16
PART = 1 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """Base matches of one layer: (start, kind, end), leftmost and
    non-overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _compressed(data: bytes, at: int) -> bool:
    """Whether a gzip or zlib header is there."""
    if data[at:at + 3] == b"\x1f\x8b\x08":
        return True
    return len(data) > at + 2 and data[at] & 0x8F == 8 and not data[at + 1] & 0x20 and (data[at] << 8 | data[at + 1]) % 31 == 0


def _inflated(data: bytes, place: list[int]):
    """Content, in parts, of the compressed members that follow each other from
    ``place[0]`` on, which moves to the end of each whole one. Of a member that is
    broken or ends early, all that opens counts."""
    view = memoryview(data)
    while _compressed(data, place[0]):
        unpack, next_, step = zlib.decompressobj(wbits=47), place[0], 1024  # either header
        while not unpack.eof and next_ < len(data):
            todo = view[next_:next_ + step]
            next_ += step
            step = min(2 * step, 1 << 20)
            while len(todo) and not unpack.eof:
                before = unpack.copy()
                try:
                    part = unpack.decompress(todo, PART)
                except zlib.error:  # byte by byte up to the fault
                    for k in range(len(todo)):
                        try:
                            yield before.decompress(todo[k:k + 1])
                        except zlib.error:
                            return
                    return
                todo = unpack.unconsumed_tail
                yield part
        if not unpack.eof:
            try:
                yield unpack.flush()
            except zlib.error:
                pass
            return
        place[0] = min(next_, len(data)) - len(unpack.unused_data)


def _windows(parts, most: int):
    """The content in one piece if that has at most ``most`` bytes, else in overlapping ones."""
    held, overlap, new = bytearray(), min(OVERLAP, most // 2), False
    for part in parts:
        held += part
        new = new or bool(part)
        while len(held) > most:
            yield bytes(held[:most])
            del held[:most - overlap]
    if new:
        yield bytes(held)


def _members(data: bytes, places, most: int, seen: set):
    """Contents, new to ``seen``, of the compressed members at the places or, gzip, anywhere."""
    end = 0
    for at in sorted({*places, *(m.start() for m in GZIP.finditer(data))}):
        if at >= end and _compressed(data, at):
            place = [at]
            for window in _windows(_inflated(data, place), most):
                key = hashlib.sha256(window).digest()
                if key not in seen:
                    seen.add(key)
                    yield window
            end = place[0]


def _opened(data: bytes, places, most: int):
    """Contents of the compressed members in the bytes, and of those inside them;
    of what lies side by side only one is held at a time."""
    seen = set()
    todo = [_members(data, places, most, seen)]
    while todo:
        inner = next(todo[-1], None)
        if inner is None:
            todo.pop()
        else:
            yield inner
            todo.append(_members(inner, (0,), most, seen))


def _from_base64(body: str, lines, most: int):
    """Texts that a run of base64 characters holds. Content may begin anywhere in
    the run (behind parts of a path, say), so all four alignments are read;
    compressed bytes are looked for at the start of a line and after each
    character that separates parts. Bytes that are no UTF-8 stay in the text."""
    body = body.translate(URL_SAFE)
    begins = {*lines, *(m.end() for m in re.finditer("[+/]", body))}
    for k in range(4):
        n = len(body) - k
        n -= n % 4 == 1  # six bits are no byte
        data = binascii.a2b_base64(body[k:k + n] + "=" * (-n % 4))
        yield data.decode("utf-8", "surrogateescape")
        for inner in _opened(data, [(p - k) // 4 * 3 for p in begins if p % 4 == k], most):
            yield inner.decode("utf-8", "surrogateescape")


def _wrapped(layer: str):
    """(start, end, characters, starts of its lines among them) of base64 over several lines."""
    for m in WRAPPED.finditer(layer):
        breaks = [x.span() for x in BREAK.finditer(layer, m.start(), m.end(1))]
        lines = list(zip([m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end(1)]))
        sizes, end = [b - a for a, b in lines], m.end()
        # Other text after the last line: it is of the run if that is evidently wrapped.
        if not m[2] and not LINE_END.match(layer, end) and not (sizes[-2] >= 60 and sizes[-2] % 4 == 0 or len(sizes) > 2 and sizes[-2] == sizes[-3]):
            del lines[-1], sizes[-1]
            end = lines[-1][1]
        if len(lines) > 1:
            yield m.start(), end, "".join(layer[a:b] for a, b in lines), [0, *accumulate(sizes[:-1])]


def _percent(run: str) -> list[tuple[str, int]]:
    """Characters of a run of percent escapes, each with the length of its
    escapes; bytes that are no UTF-8 stay one character each."""
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    return [(c, 3 if c < "\x80" else 3 * len(c.encode("utf-8", "surrogateescape"))) for c in text]


def _unicode(run: str) -> list[tuple[str, int]]:
    units = "".join(chr(int(u, 16)) for u in run.split("\\u")[1:])
    return [(c, 12 if c > "\uffff" else 6) for c in units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")]


class Place:
    """Where the characters of a layer lie in the text: each has its own start
    and end there, or all lie in one encoded run."""

    def __init__(self, starts, ends):
        self.starts, self.ends = starts, ends

    def of(self, start: int, end: int) -> tuple[int, int]:
        return (self.starts, self.ends) if isinstance(self.starts, int) else (self.starts[start], self.ends[end - 1])

    def run(self, start: int, end: int) -> Place:
        """The place of a layer that lies in one run of this layer."""
        return Place(*self.of(start, end))

    def key(self):
        return (self.starts, self.ends) if isinstance(self.starts, int) else hashlib.sha256(self.starts.tobytes() + self.ends.tobytes()).digest()


def decoded(layer: str, place: Place, escapes: re.Pattern, opened):
    """The layer with all its escapes of one kind decoded: (text, its place) of
    every stretch that a decoded character is in or beside. No match and no
    encoded run leaves its stretch, and the other stretches are as they were."""
    inside, at, n, texts, fresh = isinstance(place.starts, int), 0, 0, [], []
    starts, ends = array("q"), array("q")
    for m in escapes.finditer(layer):
        chars = opened(m[0])
        texts += layer[at:m.start()], "".join(c for c, _ in chars)
        n += m.start() - at
        fresh.append((n, n + len(chars)))
        n += len(chars)
        if not inside:
            starts.extend(place.starts[at:m.start()])
            ends.extend(place.ends[at:m.start()])
            k = m.start()
            for _, width in chars:
                starts.append(place.starts[k])
                k += width
                ends.append(place.ends[k - 1])
        at = m.end()
    if not fresh:
        return
    texts.append(layer[at:])
    if not inside:
        starts.extend(place.starts[at:])
        ends.extend(place.ends[at:])
    k = 0
    for m in STRETCH.finditer("".join(texts)):
        while k < len(fresh) and fresh[k][1] < m.start():
            k += 1
        if k == len(fresh):
            return
        if fresh[k][0] <= m.end():
            yield m[0], place if inside else Place(starts[m.start():m.end()], ends[m.start():m.end()])


def unwrapped(layer: str, place: Place, most: int = WINDOW):
    """(inner text, its place) of everything encoded in a layer."""
    for sign, escapes, opened in (("%", PERCENT, _percent), ("\\u", UNICODE, _unicode)):
        if sign in layer:
            yield from decoded(layer, place, escapes, opened)
    runs = [(m.start(), m.end(), m[0].rstrip("="), [0]) for m in BASE64.finditer(layer)]
    if runs:
        runs += _wrapped(layer)
    for start, end, body, lines in runs:
        for inner in _from_base64(body, lines, most):
            yield inner, place.run(start, end)


def find_in_text(text: str, most: int = WINDOW) -> tuple[list, list]:
    """Base matches of the text itself, and all spans with those of inner layers
    mapped to the text: (start, kind, end)."""
    base = scan(text)
    found, seen = set(base), set()
    todo = [unwrapped(text, Place(range(len(text)), range(1, len(text) + 1)), most)]
    while todo:
        layer, place = next(todo[-1], (None, None))
        if layer is None:
            todo.pop()
            continue
        key = (hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest(), place.key())
        if key in seen:
            continue
        seen.add(key)
        for start, kind, end in scan(layer):
            start, end = place.of(start, end)
            found.add((start, kind, end))
        todo.append(unwrapped(layer, place, most))
    return base, sorted(found)


SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_secrets(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with secrets: array of (kind, start, end, base) by start, kind, end."""
    own = docs.drop("secrets")
    own = own.withColumn(text, F.col(text).cast("string"))
    names = own.columns

    def run(batches):
        for piece in pieces(batches, text):
            out = []
            for value in piece.column(names.index(text)).to_pylist():
                base, found = find_in_text(value, window) if value else ((), ())
                base = set(base)
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in base} for a, k, b in found])
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, _ARROW)], [*names, "secrets"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("secrets", SECRETS)]))


def redact(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The text with each maximal run of secret characters replaced by a mark."""
    merged = F.expr(
        "aggregate(secrets, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) ->"
        " if(size(acc) > 0 and element_at(acc, -1).end >= s.start,"
        "    concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).end, s.end) as end))),"
        "    concat(acc, array(struct(s.start as start, s.end as end)))))")
    cut = (f"concat(array_join(transform(_spans, (s, i) -> concat(substring(`{text}`, if(i = 0, 0, get(_spans, i - 1).end) + 1,"
           f" s.start - if(i = 0, 0, get(_spans, i - 1).end)), '{mark}')), ''), substring(`{text}`, element_at(_spans, -1).end + 1))")
    return (found.withColumn("_spans", merged)
            .withColumn(text, F.when(F.size("secrets") > 0, F.expr(cut)).otherwise(F.col(text))).drop("_spans"))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def n(kind):
        return F.size(F.filter("secrets", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        F.sha2(joined(F.filter("secrets", lambda s: s["base"])), 256).alias("base_sha256"),
                        joined("secrets").alias("spans"))
