"""The crawl loop: rounds of fetching until nothing new is found.

A round asks for the URLs that the stored manifest names (the first: for the
seeds), records the answers in the manifest, and so decides what the next round
asks for. All state is in the manifest store and in a folder per round beside
it: a loop that was ended at any point goes on with the round after the last
committed one, and repeats at most the round it was in. Only whether a round's
list is empty comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import written
from ..sources.captures import validate_seeds
from ..sources.manifest_store import URLS, ManifestStore
from .incremental import next_round, record_round
from .manifest import manifest_init
from .robots import robots_filter


def check_seeds(seeds: DataFrame, rules: DataFrame) -> DataFrame:
    """seeds(seed_url) -> what ``validate_seeds`` says of them, their site and
    canonical url, and whether the site's robots rules allow them (null for bad ones)."""
    u = U.parsed("seed_url")
    path = U.parsed("url")["path"]
    own = (validate_seeds(seeds).withColumn("_u", u)
           .withColumn("site", F.when(F.col("ok"), U.site_of(F.col("_u.host"))))
           .withColumn("url", F.when(F.col("ok"), U.serialize(F.col("_u")))).drop("_u").withColumn("path", path))
    return robots_filter(own, rules).withColumn("allowed", F.when(F.col("ok"), F.col("allowed"))).drop("path")


def recorded(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch function that replays recorded captures: all of those of the URLs
    asked for. Captures are written once with their canonical URL, so a round parses
    none. Bodies move only if the list asked for is too large to broadcast."""
    key = U.parsed("url")
    keyed = written(answers.withColumn("_url", F.when(key.isNotNull(), U.serialize(key))))

    def fetch(asked: DataFrame) -> DataFrame:
        return keyed.join(asked.select(F.col("url").alias("_url")).distinct(), "_url", "left_semi").drop("_url")
    return fetch


def _asked(store: ManifestStore, k: int, seeds: DataFrame, rules: DataFrame, check_seed: bool) -> DataFrame:
    if k:
        return next_round(store, rules).where("decision = 'fetch'").select("site", "url")
    first = check_seeds(seeds.select("seed_url"), rules).where("ok")
    return (first.where("allowed") if check_seed else first).select("site", "url").distinct()


def crawl(store: ManifestStore, fetch: Callable[[DataFrame], DataFrame], seeds: DataFrame, rules: DataFrame,
          check_seed: bool = False, max_rounds: int | None = None) -> int:
    """Rounds until nothing new is found, or ``max_rounds`` more; the number that
    were recorded. ``fetch`` takes a list (site, url) and returns captures; a URL
    without an answer counts as visited. Seeds(site, seed_url) are asked for whatever
    the robots rules say, unless ``check_seed``."""
    spark, done = store.spark, 0
    while max_rounds is None or done < max_rounds:
        last = store.last()
        k = last["round_id"] + 1 if last else 0
        asked, answers = f"{store.path}/asked/round={k}", f"{store.path}/answers/round={k}"
        _asked(store, k, seeds, rules, check_seed).write.mode("overwrite").parquet(asked)
        urls = spark.read.schema(URLS).parquet(asked)
        if urls.isEmpty():
            break
        fetch(urls).write.mode("overwrite").parquet(answers)
        record_round(store, k, spark.read.parquet(answers), manifest_init(seeds), urls)
        done += 1
    return done


def crawl_log(store: ManifestStore) -> DataFrame:
    """(site, url, round): every URL asked for in a committed round."""
    last = store.last()
    try:
        log = store.spark.read.schema(f"{URLS}, round int").parquet(f"{store.path}/asked")
    except PySparkException:  # nothing was ever asked for
        return store.spark.createDataFrame([], f"{URLS}, round int")
    return log.where(F.col("round") <= F.lit(last["round_id"] if last else -1))
