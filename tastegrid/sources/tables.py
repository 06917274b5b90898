"""Reading raw tables, writing results, and choosing target users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.hashing import hash_key
from tastegrid.functions.numeric import to_number
from tastegrid.operators.recommend import nest


def read_raw(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header or parquet, by file ending. CSV columns are strings unless a schema is given."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def load_interactions(df: DataFrame) -> DataFrame:
    """Ids as strings; both are required."""
    for column in ("user_id", "item_id"):
        if column not in df.columns:
            raise ValueError(f"interactions need the column {column}")
    return df.withColumns({c: F.col(c).cast("string") for c in ("user_id", "item_id")})


def load_items(df: DataFrame, numeric: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """String ids and numbers without nulls; returns the table and the numeric columns it has."""
    present = [c for c in numeric if c in df.columns]
    return df.withColumns({"item_id": F.col("item_id").cast("string"), **{c: to_number(F.col(c)) for c in present}}), present


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def write_split(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder per split value, so that reading one split prunes the others."""
    writer = df.write.mode("overwrite").partitionBy("split")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def write_recommendations(recs: DataFrame, path: str) -> None:
    """One JSON object per user with its ranked list."""
    nest(recs).write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str, **run_info) -> None:
    metrics.withColumns({k: F.lit(v) for k, v in run_info.items()}).write.mode("overwrite").json(path)


def users_from_list(spark: SparkSession, ids: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(str(i),) for i in ids], "user_id string")


def users_from_file(spark: SparkSession, path: str) -> DataFrame:
    """One id per line; blank lines do not count."""
    return spark.read.text(path).select(F.trim("value").alias("user_id")).filter(F.col("user_id") != "")


def sample_users(interactions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    users = interactions.select("user_id").distinct()
    return users.orderBy(hash_key("user_id", seed=seed), "user_id").limit(n)


def first_users(interactions: DataFrame, n: int = 5) -> DataFrame:
    return interactions.select("user_id").distinct().orderBy("user_id").limit(n)
