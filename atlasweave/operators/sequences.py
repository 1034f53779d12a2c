"""Totals, ranks and neighbours along an order, for groups of any size.

A window over a group runs in one task. Here rows are dealt to range partitions by group and order, so a large group is
spread over many tasks; each works on its stretch, and a small table of one row for each (group, partition) tells what stands
before and behind a stretch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls included."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, by keys that may be null."""
    named = right.select(*(F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns))
    condition = reduce(lambda a, b: a & b, (left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys))
    return left.join(named, condition, how).drop(*(f"_r_{k}" for k in keys))


def in_order(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """``rows`` dealt out and sorted by keys and order, with ``_part`` and ``_row`` (ascending along both); written once, so
    that a lost executor can't deal them differently."""
    by = [*keys, *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))


def running_total(ordered: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of a group up to and with each row. Needs ``in_order`` rows, or some of them."""
    rows = ordered.withColumn("_value", value)
    stretches = rows.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    return joined(rows.withColumn("_inside", F.sum("_value").over(inside)), before, [*keys, "_part"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_value")


def neighbours(ordered: DataFrame, keys: list[str], column: str, before: str, behind: str) -> DataFrame:
    """Add the value of ``column`` in the rows before and behind each row of its group; null at the group's ends."""
    inside = Window.partitionBy(*keys, "_part").orderBy("_row")
    rows = ordered.withColumns({"_lag": F.lag(column).over(inside), "_lead": F.lead(column).over(inside), "_first": F.lag("_row").over(inside).isNull(), "_last": F.lead("_row").over(inside).isNull()})
    edges = ordered.groupBy(*keys, "_part").agg(F.min_by(column, "_row").alias("_head"), F.max_by(column, "_row").alias("_tail"))
    parts = Window.partitionBy(*keys).orderBy("_part")
    around = edges.select(*keys, "_part", F.lag("_tail").over(parts).alias("_previous"), F.lead("_head").over(parts).alias("_following"))
    rows = joined(rows, around, [*keys, "_part"])
    found = {before: F.when(F.col("_first"), F.col("_previous")).otherwise(F.col("_lag")), behind: F.when(F.col("_last"), F.col("_following")).otherwise(F.col("_lead"))}
    return rows.withColumns(found).drop("_lag", "_lead", "_first", "_last", "_previous", "_following")
