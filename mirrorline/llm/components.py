"""Connected components of an undirected link table, wholly as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): label is the smallest node reachable.

    Each round a node takes the smallest label among its own, its neighbours'
    and its label's label (pointer jumping), so a chain of length n needs about
    log n rounds. Tables are kept as reliable checkpoints between rounds; only
    the number of changed labels comes to the driver. Both sides of each join
    are plain tables, so that adaptive execution can split a hub's partition;
    minima are pre-aggregated before they are shuffled. No link: empty table."""
    both = saved(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                 .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct())
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        own = labels.select("node", "label", F.col("label").alias("was"))
        near = (both.join(labels.withColumnRenamed("node", "v"), "v")
                .select(F.col("u").alias("node"), "label", F.lit(None).cast("bigint").alias("was")))
        jump = (labels.select("node", F.col("label").alias("via"))
                .join(labels.select(F.col("node").alias("via"), "label"), "via")
                .select("node", "label", F.lit(None).cast("bigint").alias("was")))
        new = saved(own.unionByName(near).unionByName(jump).groupBy("node").agg(F.min("label").alias("label"), F.min("was").alias("was")))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels
