"""Legacy archive converter: ARC records in, equivalent WARC records out.

An ARC file starts with a version block that names the fields of its header
lines (five in version 1, ten in version 2); every record is a header line with
a declared length and that many bytes. The converter follows the declared
lengths only, then makes the WARC record: an identifier derived from what the
record is, an ISO time, a type, and SHA-256 digests of block and payload.

Records with equal payloads of at least ``REVISIT_BYTES`` become one response
(the smallest key) and revisits that refer to it. Archives are written as
gzipped files of at most ``FILE_BYTES`` of records, so that each can be read as one
value, and parsed back one record at a time.

Defined cases: a null payload is empty; a null or odd address is written as "-"
or percent-encoded; equal pages (same key and payload) are the same record and
take the same type; a null key sorts behind the others; empty tables give empty
archives; a truncated or malformed archive raises ValueError with its offset.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import pieces, saved, table

REVISIT_BYTES = 100
ARC_BYTES = 1 << 20
FILE_BYTES = 16 << 20
CAPTURED = "20240101000000"

# Header fields of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


def _address(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def arc_bytes(name: str, version: int, records) -> bytes:
    """An ARC file of (url, date, content type, block) records."""
    def line(url, kind, size, date, offset):
        if version == 1:
            return f"{url} 0.0.0.0 {date} {kind} {size}\n".encode()
        return f"{url} 0.0.0.0 {date} {kind} 200 - - {offset} {name} {size}\n".encode()

    head = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out = io.BytesIO()
    out.write(line(f"filedesc://{name}", "text/plain", len(head), CAPTURED, 0) + head)
    for url, date, kind, block in records:
        out.write(line(_address(url), kind, len(block), date, out.tell()) + block + b"\n")
    return out.getvalue()


def parse_arc(content: bytes):
    """(fields, block) of every record behind the version block."""
    at, names = 0, None
    while at < len(content):
        if names is not None and content[at: at + 1] == b"\n":  # between records
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line ends after byte {at}")
        line = content[at:end].decode("utf-8", "surrogateescape")
        try:
            size = int(line.rsplit(" ", 1)[1])
        except (IndexError, ValueError):
            raise ValueError(f"no declared length in the header line at byte {at}") from None
        block = content[end + 1: end + 1 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is shorter than declared")
        if names is None:
            lines = block.decode("ascii").split("\n")
            version = int(lines[0].split(" ")[0])
            names = tuple(lines[1].split(" "))
            if ARC_FIELDS.get(version) != names:
                raise ValueError(f"unknown archive version {version}")
        else:
            values = line.rsplit(" ", len(names) - 1)  # an old address may hold spaces
            if len(values) != len(names):
                raise ValueError(f"the header line at byte {at} has {len(values)} fields")
            yield dict(zip(names, values, strict=True)), block
        at = end + 1 + size


def converted(fields: dict, block: bytes) -> dict:
    """What the WARC record of an ARC record holds."""
    is_http = block.startswith(b"HTTP/")
    cut = block.find(b"\r\n\r\n") + 4 if is_http else 0
    header, payload = (block[:cut], block[cut:]) if cut > 3 else (b"", block)
    date = fields["Archive-date"]
    digest = hashlib.sha256(payload).hexdigest()
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    return {"record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {date} {hashlib.sha256(block).hexdigest()}")),
            "kind": "response" if is_http else "resource", "uri": fields["URL"], "date": stamp,
            "content_type": "application/http; msgtype=response" if is_http else fields["Content-type"],
            "header": header, "payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


CONVERTED = "record_id string, kind string, uri string, date string, content_type string, header binary, payload binary, payload_bytes bigint, payload_digest string"
_CONVERTED = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()),
                        ("header", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def convert(archives: DataFrame, content: str = "content") -> DataFrame:
    """ARC files (a binary column) -> one row per record, as the WARC record's parts."""
    def run(batches):
        for batch in batches:
            for one in batch.column(0):
                rows = [converted(f, b) for f, b in parse_arc(one.as_py() or b"")]
                for a in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[a: a + 256], _CONVERTED)

    return archives.select(F.col(content).alias("content")).mapInArrow(run, CONVERTED)


def legacy_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """ARC files (name, content) of pages, alternately of version 1 and 2; the
    page's key travels in the stored response's header."""
    own = pages.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches):
        for k, piece in enumerate(pieces(batches, "html", ARC_BYTES)):
            records = []
            for key, url, html in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                body = (html or "").encode("utf-8")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if key is None else key}\r\nContent-Length: {len(body)}\r\n\r\n"
                records.append((url, CAPTURED, "text/html", head.encode() + body))
            name = f"pages-{k}.arc"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_bytes(name, 1 + k % 2, records)], pa.binary())], ["name", "content"])

    return own.mapInArrow(run, "name string, content binary")


def with_revisits(records: DataFrame, key: str = "key") -> DataFrame:
    """Adds refers_to (key) and refers_to_id to every record but the first of
    those with equal payloads of at least ``REVISIT_BYTES``."""
    row = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.col("record_id").alias("id"))
    first = saved(records.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
                  .agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first"))
    out = records.join(first, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("first.id") != F.col("record_id"))
    return out.select(*records.columns, F.when(again, F.col("first.key")).alias("refers_to"), F.when(again, F.col("first.id")).alias("refers_to_id"))


def _record(r: dict) -> bytes:
    """A WARC record without the empty lines that end it."""
    revisit = r["refers_to_id"] is not None
    block = r["header"] if revisit else r["header"] + r["payload"]
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else r['kind']}", f"WARC-Record-ID: <urn:uuid:{r['record_id']}>", f"WARC-Date: {r['date']}",
             f"WARC-Target-URI: {r['uri']}", f"Content-Type: {r['content_type']}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {r['payload_bytes']}"]
    if r["key"] is not None:
        lines.append(f"X-Page-Id: {r['key']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{r['refers_to_id']}>"]
        if r["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page: {r['refers_to']}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped WARC files at ``path``, each of at most ``file_bytes`` bytes of records
    before compression (or of one record that is larger)."""
    names = records.columns
    end = b"\r\n\r\n"

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for r in batch.slice(k, 256).to_pylist():
                    record = _record(r)
                    if held and size + len(record) > file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["file"])
                        held, size = [], 0
                    held.append(record)
                    size += len(record) + len(end)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["file"])

    files = records.select(*names).mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("lineSep", end.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_warc(stream):
    """(headers, block) of every record of a binary stream, by declared lengths."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC version line where a record should start")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("an archive ends inside a record's header")
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record is shorter than declared")
        yield headers, block


READ = "record_id string, warc_type string, uri string, date string, key string, refers_to string, payload binary, payload_bytes bigint, payload_digest string"
_READ = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("key", pa.string()), ("refers_to", pa.string()),
                   ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives at ``path``. The digest and length of a stored
    payload are worked out anew and must be what the header says."""
    def one(headers, block):
        kept = headers["warc-type"] != "revisit"
        cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
        payload = block[cut:] if kept else None
        digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
        if kept and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"the payload of {headers['warc-record-id']} is not what its header says")
        return {"record_id": headers["warc-record-id"][10:-1], "warc_type": headers["warc-type"], "uri": headers["warc-target-uri"], "date": headers["warc-date"],
                "key": headers.get("x-page-id"), "refers_to": headers.get("x-refers-to-page"), "payload": payload if with_payload else None,
                "payload_bytes": size, "payload_digest": digest}

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    rows.append(one(headers, block))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, READ)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: all of ``pages`` as legacy archives, converted, written
    as WARC in the shared folder, and read back."""
    records = convert(legacy_archives(table(spark, sf_dir, "pages")))
    key = F.nullif(F.regexp_extract(F.col("header").cast("string"), r"\r\nX-Page-Id: ([^\r]*)\r\n", 1), F.lit(""))
    records = records.withColumn("key", key.cast("bigint"))
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(with_revisits(records), path)
    back = read_archives(spark, path, with_payload=False)
    return back.select(F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
                       F.col("refers_to").cast("bigint").alias("refers_to"))


OP7_SQL = """
with p as (select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, p.payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from p left join f on p.payload_digest = f.payload_digest
"""
