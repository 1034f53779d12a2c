"""Connected components of a link table by alternating large-star and small-star steps, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasweave.llm.frames import saved


def _minima(pairs: DataFrame) -> DataFrame:
    return saved(pairs.groupBy("u").agg(F.min("v").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two columns of one orderable type); root is the smallest node it can reach.

    Each round hangs the larger neighbours of a node under its smallest one, then does the same
    downwards; the rounds grow with the logarithm of the longest chain. Minima are aggregates
    that combine before the shuffle, and they are written before they are joined, so that a node with
    very many links is a skewed join which Spark splits. Nulls and self-links are ignored.
    """
    a, b = links.columns
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs, seen = saved(pairs), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        around = _minima(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = pairs.join(around.select(F.col("u").alias("c"), "m"), F.col("v") == F.col("c")).select("u", F.least("m", "v").alias("v")).distinct()
        large = saved(large)
        below = _minima(large)
        small = large.join(below.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = saved(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
