"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """v scaled to length one; the zero vector stays zero."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [-1, 1]; 0 when either vector is zero."""
    scale = norm(a) * norm(b)
    value = F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, x: acc + x))
