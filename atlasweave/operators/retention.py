"""Stored scans: bounded logs, retention and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ordering import number_rows

FINISHED = ["completed", "stopped", "failed"]


def bounded_log(rows: DataFrame, group: list[str], order: list[str], keep: int, give: int | None = None) -> DataFrame:
    """The latest entries of each group's log: at most ``give`` of the ``keep`` that are stored.

    The rank filter is applied before the shuffle too, so a group sends a few hundred rows
    per task however long its log is.
    """
    newest = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= min(keep, give or keep))


def scan_retention(scans: DataFrame, group: list[str], now: Column, limit: int = K.MAX_SCANS) -> DataFrame:
    """Add ``fate``: ``expired`` (finished and idle beyond the time limit), ``evicted`` (oldest
    finished while the store is full) or ``kept``.

    Expects scan_id, status, started_at and updated_at.
    """
    finished = F.col("status").isin(*FINISHED)
    idle = F.col("updated_at") < now - F.expr(f"INTERVAL {K.SCAN_TTL_HOURS} HOURS")
    df = scans.withColumn("_expired", finished & idle)
    live = df.filter("not _expired")
    stored = live.groupBy(*group).agg(F.count(F.lit(1)).alias("_stored"))
    ranked = number_rows(live.filter(finished), group, ["started_at", "scan_id"], "_turn")
    ranked = ranked.join(stored, group)
    # One place is freed for the scan being created.
    evicted = F.col("_turn") <= F.col("_stored") - (limit - 1)
    columns = scans.columns
    return (
        df.filter("_expired").select(*columns, F.lit("expired").alias("fate"))
        .unionByName(ranked.select(*columns, F.when(evicted, "evicted").otherwise("kept").alias("fate")))
        .unionByName(live.filter(~finished).select(*columns, F.lit("kept").alias("fate")))
    )


def recent_scans(scans: DataFrame, limit: int = 20) -> DataFrame:
    """The scans started last; a top-k report."""
    return scans.orderBy(F.desc("started_at"), F.desc("scan_id")).limit(limit)
