"""What the operators share: tables, written intermediate results, a numbering without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names; a local one only on a local master where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, a lost executor costs nothing, and later reads prune columns."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that other columns of the input cannot clash."""
    return df.select(*(df[source].alias(name) for name, source in columns.items()))


def numbered(rows: DataFrame, group: str, spread: Column, out: str, buckets: int, weight: Column | None = None) -> DataFrame:
    """Gapless numbers from 0 within ``group``, however many rows one group holds.

    Rows are spread over ``buckets`` of their group by ``spread``; a window numbers each
    bucket, and a second one over the small table of bucket totals gives each bucket its start.
    With ``weight`` the number is the running total of the weights before the row.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int")).withColumn("_w", weight)
    totals = rows.groupBy(group, "_bucket").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(spread).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return rows.join(starts, [group, "_bucket"]).withColumn(out, F.col("_start") + F.col("_in")).drop("_start", "_in", "_bucket", "_w")
