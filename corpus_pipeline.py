"""A corpus through five operators, each stage on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame. All but the last return the columns of ``documents``. No stage
drops or changes a document that its operator finds nothing in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorline.llm import decontaminate, pieces, secrets, simhash, toxicity
from mirrorline.llm.common import table
from mirrorline.llm.sample import remainder
from mirrorline.session import ensure_checkpoint_dir

TOXIC = 0.5  # documents that score this or more go
SHINGLE, MAX_DISTANCE = 3, 3

#: The stages are not expressible in SQL (chain model, FM-index, decoding worklist, lattice).
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (fitted on rows that are not held out)
    accepts; all if the labels do not let it be fitted."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    if not model.fitted:
        return docs
    return toxicity.tag(docs, model).where(F.col("score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_of_each(docs, shingle=SHINGLE, max_distance=MAX_DISTANCE)


def _with_length(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``; n_chars follows a changed text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_changed"), F.length("text").cast("bigint")).otherwise(F.col("n_chars").cast("bigint")))
    return changed.select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that occur in benchmark items."""
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark")).withColumn("_changed", F.size("spans") > 0)
    return _with_length(docs, decontaminate.cut_spans(found))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    found = secrets.find_secrets(docs).withColumn("_changed", F.size("secrets") > 0)
    return _with_length(docs, secrets.redact(found))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its other columns but the text."""
    return pieces.encode_documents(docs, keep_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the
    shared checkpoint folder, read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
