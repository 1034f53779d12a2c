"""Computed-once columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps see as finished values.

    A chain of plain projections is folded by the optimizer, and a filter on its result is
    pushed down with every definition copied in, so a derived value used five times is
    computed five times and the plan grows exponentially with the chain. Emitting the
    columns through a one-row ``inline`` keeps them in whole-stage code generation while
    stopping both rewrites at that point.
    """
    old = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*old, F.inline(F.array(row)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once and only where the whole expression is."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
