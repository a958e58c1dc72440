"""Fetch outcomes from an attempt log (the retry policy, as an aggregate)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Fixed values of the retry policy.
MAX_RETRIES = 2
BACKOFF_BASE_MS = 500


def retryable(status):
    return status.isNull() | ((status >= 500) & (status <= 599)) | (status == 429)


def fetch_outcomes(attempts: DataFrame) -> DataFrame:
    """attempts(url, attempt 0-based, status NULL = network error) ->
    one outcome per URL: ok (200), failed (other status, no retry),
    exhausted (3 retryable answers), pending (log ends early).
    Aggregated with partial (map-side) combine; no per-URL list is built."""
    tries = MAX_RETRIES + 1
    a = attempts.where(F.col("attempt") < tries)
    term = F.when(~retryable(F.col("status")), F.col("attempt"))
    g = a.groupBy("url").agg(
        F.min(term).alias("terminal"),
        F.min_by(F.col("status"), term).alias("terminal_status"),
        F.count("*").alias("logged"))
    used = F.when(F.col("terminal").isNotNull(), F.col("terminal") + 1).otherwise(
        F.least(F.col("logged"), F.lit(tries)))
    outcome = (F.when(F.col("terminal").isNotNull() & (F.col("terminal_status") == 200), F.lit("ok"))
               .when(F.col("terminal").isNotNull(), F.lit("failed"))
               .when(F.col("logged") >= tries, F.lit("exhausted"))
               .otherwise(F.lit("pending")))
    backoff = (F.lit(BACKOFF_BASE_MS) * (F.pow(F.lit(2), used - 1) - 1)).cast("bigint")
    return g.select("url", outcome.alias("outcome"), F.col("terminal_status").alias("status"),
                    used.cast("int").alias("attempts"), backoff.alias("backoff_ms"))


def error_stats(outcomes: DataFrame) -> DataFrame:
    """Failed URLs per site (failed or exhausted)."""
    return (outcomes.where(F.col("outcome").isin("failed", "exhausted"))
            .groupBy(U.site_of(U.parsed("url")["host"]).alias("site"))
            .agg(F.count("*").alias("errors")))
