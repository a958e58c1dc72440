"""Captured responses: the engine's input table.

``captures(url, status, content_type, last_modified, body, seq)`` — one row
per fetched response. Only status 200 counts as content; other rows are kept
for error statistics. ``seq`` orders captures of the same URL (last wins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPTURES_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("last_modified", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("seq", T.LongType()),
])

RENDERED_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("requested_urls", T.ArrayType(T.StringType())),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures_from_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as successful HTML captures."""
    return pages.select(
        F.col("url"),
        F.lit(200).cast("int").alias("status"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("last_modified"),
        F.col("html").alias("body"),
        F.col("page_id").cast("bigint").alias("seq"),
    )


def load_captures(spark: SparkSession, path: str, fmt: str = "parquet", binary: bool = False) -> DataFrame:
    """Read a captures table with its fixed schema (never inferred). ``binary``:
    bodies are bytes, as images and fonts need (see ``build_mirror``)."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if binary and f.name == "body" else f for f in CAPTURES_SCHEMA.fields])
    return spark.read.schema(schema).format(fmt).load(path)


def load_captures_checked(spark: SparkSession, path: str, fmt: str = "json", binary: bool = False) -> tuple[DataFrame, DataFrame]:
    """Captures that can be used, and a table of errors: one row for every record
    that is malformed, has no usable address or number, or failed.

    errors(site, url, seq, status, reason, outcome, record): the first reason that
    holds; ``record`` is the text of a malformed one (of which nothing else is
    trusted), ``outcome`` is "failed", so that ``error_stats`` takes the table."""
    body = T.BinaryType() if binary else T.StringType()
    fields = [T.StructField(f.name, body) if f.name == "body" else f for f in CAPTURES_SCHEMA.fields]
    reader = spark.read.schema(T.StructType([*fields, T.StructField("_bad", T.StringType())]))
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").format(fmt).load(path)
    from ..functions import urls as U
    u = U.parsed("url")
    reason = (F.when(F.col("_bad").isNotNull(), F.lit("malformed record"))
              .when(F.trim(F.coalesce("url", F.lit(""))) == "", F.lit("missing url"))
              .when(u.isNull(), F.lit("invalid url"))
              .when(F.col("seq").isNull(), F.lit("missing seq"))
              .when(F.col("status").isNull(), F.lit("no response"))
              .when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"))))
    # status and seq stay in both, so that their types are checked for both
    marked = rows.withColumn("reason", reason)
    good = marked.where(F.col("reason").isNull()).select(*[f.name for f in CAPTURES_SCHEMA.fields])
    whole = F.col("_bad").isNull()
    bad = marked.where(F.col("reason").isNotNull()).select(
        F.when(whole, U.site_of(u["host"])).alias("site"), *[F.when(whole, F.col(c)).alias(c) for c in ("url", "seq", "status")],
        "reason", F.lit("failed").alias("outcome"), F.col("_bad").alias("record"))
    return good, bad


def text_bodies(captures: DataFrame) -> DataFrame:
    """Captures with binary bodies read as UTF-8, U+FFFD for malformed bytes: what
    the link extraction takes."""
    if dict(captures.dtypes)["body"] != "binary":
        return captures
    return captures.withColumn("body", F.make_valid_utf8(F.col("body").cast("string")))


def successful(captures: DataFrame) -> DataFrame:
    """Responses that count as content: status exactly 200; an empty
    Last-Modified is no Last-Modified."""
    return (captures.where(F.col("status") == 200)
            .withColumn("last_modified",
                        F.when(F.col("last_modified") == "", F.lit(None)).otherwise(F.col("last_modified"))))


def validate_seeds(seeds: DataFrame) -> DataFrame:
    """seeds(seed_url) -> (seed_url, ok, reason, output): http(s) scheme and a
    host are required; the output folder defaults to the host."""
    from ..functions import urls as U
    s = U.clean_input(F.col("seed_url"))
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    parsed = U.parsed("seed_url")
    reason = (F.when(scheme == "", F.lit("invalid url"))
              .when(~scheme.isin("http", "https"), F.lit("scheme must be http or https"))
              .when(parsed.isNull(), F.lit("missing or invalid host"))
              .otherwise(F.lit(None)))
    return seeds.select("seed_url", reason.isNull().alias("ok"), reason.alias("reason"),
                        parsed["host"].alias("output"))
