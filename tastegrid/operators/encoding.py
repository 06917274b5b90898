"""Dictionaries (value -> dense index) and numeric scaling with fitted state kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.numeric import to_number
from tastegrid.operators.ranking import dense_index

METHODS = ("standardization", "min_max", "log1p", "none")


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """Dictionary (value, idx): distinct strings in order, numbered from 0."""
    values = df.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return dense_index(values, [F.col("value")])


def encode(df: DataFrame, column: str, labels: DataFrame, index: str, unknown: str = "drop") -> DataFrame:
    """Add the index of ``column``; rows with an unknown value are dropped or keep a null index."""
    if unknown not in ("drop", "null"):
        raise ValueError("unknown must be 'drop' or 'null'")
    lookup = labels.select(F.col("value").alias(column), F.col("idx").alias(index))
    return df.join(lookup, column, "inner" if unknown == "drop" else "left")


def decode(df: DataFrame, index: str, labels: DataFrame, column: str) -> DataFrame:
    return df.join(labels.select(F.col("idx").alias(index), F.col("value").alias(column)), index)


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with mean, population std, min and max; missing numbers count as 0."""
    x = {c: to_number(F.col(c)) for c in columns}
    stats = df.agg(*[F.struct(F.lit(c).alias("column"), F.avg(x[c]).alias("mean"), F.stddev_pop(x[c]).alias("std"),
                              F.min(x[c]).alias("min"), F.max(x[c]).alias("max")).alias(f"s{i}")
                     for i, c in enumerate(columns)])
    rows = stats.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s"))
    return rows.select("s.*")


def scale(df: DataFrame, columns: list[str], stats: DataFrame | None, method: str = "standardization") -> DataFrame:
    """Scale the columns in place. Without fitted stats the numbers pass through unscaled."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling method: {method}")
    raw = {c: to_number(F.col(c)) for c in columns}
    if method == "log1p":
        return df.withColumns({c: F.log1p(x) for c, x in raw.items()})
    if method == "none" or stats is None:
        return df.withColumns(raw)
    entry = F.struct("column", F.struct("mean", "std", "min", "max"))
    packed = stats.agg(F.map_from_entries(F.collect_list(entry))).scalar()   # one entry per numeric column
    out = df.withColumn("_s", packed)
    for c, x in raw.items():
        s = F.col("_s")[c]
        if method == "standardization":
            shift, width = s["mean"], s["std"]
        else:
            shift, width = s["min"], s["max"] - s["min"]
        out = out.withColumn(c, (x - shift) / F.when(width == 0, F.lit(1.0)).otherwise(width))
    return out.drop("_s")
