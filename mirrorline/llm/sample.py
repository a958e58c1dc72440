"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Bounds of a fitting sample: rows of each class, and bytes of text over all.
ROWS_PER_CLASS = 4000
MAX_BYTES = 9 << 20

_STEPS = 1 << 30


def _share(salt: int):
    """A number in 0..2**30 - 1 fixed by the id."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(_STEPS))


def remainder(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def weighted_sample(docs: DataFrame, labels: DataFrame, label: str, allowed,
                    rows_per_class: int = ROWS_PER_CLASS, max_bytes: int = MAX_BYTES):
    """(texts, labels 0/1, weights) of a sample fixed by the ids, as lists on the
    driver. A row's weight is the number of its class's documents it stands for.

    At most about ``rows_per_class`` rows of each class and ``max_bytes`` of text:
    the share taken is worked out from the classes' counts and the bytes. Rows
    with a null id or label never train; conflicting labels of an id count as 1.
    ``allowed`` tells which ids may train (a condition over doc_id)."""
    own = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
           .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}  # two classes
    taken = None
    for y, n in counts.items():
        part = (F.col("y") == y) & (_share(1) < int(_STEPS * min(1.0, rows_per_class / n)))
        taken = part if taken is None else taken | part
    if taken is None:
        return [], [], []
    # The sample is bounded by rows_per_class, so it can be broadcast.
    rows = saved(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
                 .join(F.broadcast(own.where(taken)), "doc_id"))
    classes = rows.groupBy("y").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("rows")).collect()
    whole = {r["y"]: r["rows"] * max(1.0, counts[r["y"]] / rows_per_class) for r in classes}
    sizes = sorted((r["size"], r["y"]) for r in classes)
    kept, left = F.lit(False), max_bytes
    for k, (size, y) in enumerate(sizes):  # the smaller class first: it may take its part whole
        part = min(size, left // (len(sizes) - k))
        kept = kept | ((F.col("y") == y) & (_share(2) < int(_STEPS * (part / size if size else 1.0))))
        left -= part
    rows = rows.where(kept)
    got = sorted(((r["doc_id"], r["text"], r["y"]) for r in rows.toLocalIterator()))
    n = Counter(y for _, _, y in got)
    return [t for _, t, _ in got], [y for _, _, y in got], [whole[y] / n[y] for _, _, y in got]


def labelled_sample(*args, **kwargs):
    """(texts, labels 0/1) of ``weighted_sample``."""
    return weighted_sample(*args, **kwargs)[:2]
