"""Raw tables -> cleaned, filtered and aligned tables, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.text import clean_text_columns
from tastegrid.operators.encoding import fit_scaler
from tastegrid.operators.filtering import (align_items, fill_tag, filter_by_activity, group_rare, keep_valid_items)
from tastegrid.sources.state import fit_or_load
from tastegrid.sources.tables import load_interactions, load_items, write_table


def preprocess(items: DataFrame, interactions: DataFrame, valid_ids: DataFrame | None = None,
               text_columns: Sequence[str] = (), numeric: Sequence[str] = (), min_user: int = 5, min_item: int = 3,
               rare_tag: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(items, interactions, numeric columns) ready for splitting. ``valid_ids`` are items with a good image."""
    table, present = load_items(items, numeric)
    rows = load_interactions(interactions)
    if "tag" in table.columns:
        table = fill_tag(table)
    table = clean_text_columns(table, [c for c in text_columns if c != "tag"])
    if valid_ids is not None:
        table, rows = keep_valid_items(table, valid_ids), keep_valid_items(rows, valid_ids)
    rows = filter_by_activity(rows, min_user, min_item)
    table = align_items(table, rows)
    if "tag" in table.columns:
        table = group_rare(table, rare_tag)
    return table, rows, present


def summary(items: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row: items, interactions, distinct users and items of the interactions."""
    per_user = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    users = per_user.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("interactions"), F.count(F.lit(1)).alias("users"))
    return (users.withColumn("items", items.agg(F.count(F.lit(1))).scalar())
            .withColumn("interacted_items", interactions.select("item_id").distinct().agg(F.count(F.lit(1))).scalar()))


def run(items: DataFrame, interactions: DataFrame, out: str, **options) -> DataFrame:
    """Preprocess and write items, interactions and the scaler under ``out``; returns the summary."""
    table, rows, present = preprocess(items, interactions, **options)
    spark = items.sparkSession
    write_table(rows, f"{out}/interactions")
    kept = spark.read.parquet(f"{out}/interactions")
    if kept.isEmpty():
        raise ValueError("no interactions are left after filtering")
    write_table(table, f"{out}/items")
    stored = spark.read.parquet(f"{out}/items")
    if present:
        fit_or_load(spark, f"{out}/scaler", lambda: fit_scaler(stored, present))
    return summary(stored, kept)
