"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(col: Column) -> Column:
    """Number or 0: nulls and text that is no number count as 0."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def clamp_probability(p: Column, margin: float = 1e-7) -> Column:
    return F.least(F.greatest(p, F.lit(margin)), F.lit(1.0 - margin))


def discount(rank: Column) -> Column:
    """Gain of a hit at a 1-based rank."""
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ideal_gain(hits: Column) -> Column:
    """Best possible discounted gain of ``hits`` hits (a list length, so small)."""
    ranks = F.when(hits > 0, F.sequence(F.lit(1), hits.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + discount(r))


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(empty))
