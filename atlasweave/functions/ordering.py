"""Dense numbering and ordering helpers that never funnel a group through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Dense 1-based number of each row within its group, by a unique order.

    A window over the group would put a whole group into one task. Here rows are range
    partitioned by (group, order), so a large group is spread over many partitions; the
    number is the offset of the partition within its group plus the position inside it.
    The marked rows are checkpointed, because positions must not be recomputed differently
    after an executor is lost.
    """
    keys = [*group, *order]
    marked = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = checkpointed(
        marked.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()})
    )
    heads = marked.groupBy(*group, "_part").agg(F.min("_pos").alias("_head"), F.count(F.lit(1)).alias("_size"))
    # One row per group and partition it touches: as many rows as groups plus partitions.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    numbered = marked.join(heads, [*group, "_part"])
    return numbered.withColumn(out, F.col("_offset") + F.col("_pos") - F.col("_head") + 1).drop(
        "_part", "_pos", "_head", "_size", "_offset"
    )


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]])


def _by_value(digits: Column) -> Column:
    """Digits without leading zeros, preceded by their number: longer ones are larger, equally long ones compare as text."""
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def natural_key(text: Column) -> Column:
    """Sort key that ignores case and accents and orders digit runs by value."""
    accents = "áàâäãåāéèêëēíìîïīóòôöõøōúùûüūçñýÿ"
    plain = "aaaaaaaeeeeeiiiiiooooooouuuuucnyy"
    runs = F.regexp_extract_all(F.translate(F.lower(text), accents, plain), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    padded = F.transform(
        runs, lambda r: F.when(r.rlike("^[0-9]"), _by_value(F.regexp_replace(r, "^0+([0-9])", "$1"))).otherwise(r)
    )
    return F.array_join(padded, "")
