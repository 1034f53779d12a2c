"""Rows that a join would drop, dropped before they are shuffled for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes are told apart by 25 bits: 19 name a word of 64 bits, so the table has 524,288 rows at most, whatever it was made from.
_WORD_BITS = 19


def likely(df: DataFrame, among: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``keys`` may occur in ``among``: all that do, and a few others where their hashes fall on the same bit.

    A join on the same keys must follow. The bits of ``among`` are a small table of fixed size that is broadcast, so only what the
    join will mostly keep is shuffled for it; with very many different keys it just keeps more.
    """
    word, bit = F.shiftrightunsigned("_hash", 64 - _WORD_BITS), F.col("_hash").bitwiseAND(F.lit(63)).cast("int")
    hashed = lambda rows, *more: rows.select(*more, F.xxhash64(*keys).alias("_hash"))
    bits = hashed(among).groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits"))
    kept = hashed(df, *df.columns).withColumn("_word", word).join(F.broadcast(bits), "_word").filter(F.getbit("_bits", bit) == 1)
    return kept.select(*df.columns)
