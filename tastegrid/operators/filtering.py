"""Cleaning and filtering of interaction and item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.operators.ranking import BROADCAST_ROWS
from tastegrid.session import cut


def keep_valid_items(df: DataFrame, valid: DataFrame) -> DataFrame:
    """Rows of ``df`` whose item is in ``valid``; ids are compared as strings."""
    ids = valid.select(F.col("item_id").cast("string").alias("item_id")).distinct()
    return df.withColumn("item_id", F.col("item_id").cast("string")).join(ids, "item_id", "left_semi")


def _at_least(df: DataFrame, column: str, minimum: int) -> DataFrame:
    if minimum <= 0:
        return df
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    rare = cut(counts.filter((F.col("_c") < minimum) & F.col(column).isNotNull()).select(column))
    if rare.count() <= BROADCAST_ROWS:  # few go: they travel, the rows stay
        return df.filter(F.col(column).isNotNull()).join(F.broadcast(rare), column, "left_anti")
    return df.join(counts.filter(F.col("_c") >= minimum).select(column), column, "left_semi")


def filter_by_activity(df: DataFrame, min_user: int = 5, min_item: int = 3) -> DataFrame:
    """One pass: rare items go first, users are counted on what is left. Counts are rows."""
    return _at_least(_at_least(df, "item_id", min_item), "user_id", min_user)


def align_items(items: DataFrame, interactions: DataFrame) -> DataFrame:
    return items.join(interactions.select("item_id").distinct(), "item_id", "left_semi")


def drop_seen(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """(user, item) pairs the user has no history with."""
    return pairs.join(history.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def user_history(interactions: DataFrame) -> DataFrame:
    return interactions.select("user_id", "item_id").distinct()


def filtering_stats(original: DataFrame, filtered: DataFrame, items_before: DataFrame,
                    items_after: DataFrame) -> DataFrame:
    """One row per entity with counts before and after and the retention rate."""

    def users(df):
        return df.select("user_id").distinct()

    measured = None
    for entity, before, after in (("interactions", original, filtered),
                                  ("users", users(original), users(filtered)),
                                  ("items", items_before, items_after)):
        both = (before.select(F.lit(1).alias("o"), F.lit(0).alias("f"))
                .unionAll(after.select(F.lit(0).alias("o"), F.lit(1).alias("f"))))
        row = both.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("original"),
                       F.coalesce(F.sum("f"), F.lit(0)).alias("filtered"))
        row = row.withColumn("entity", F.lit(entity))
        measured = row if measured is None else measured.unionByName(row)
    return measured.select("entity", "original", "filtered",
                           F.when(F.col("original") > 0, F.col("filtered") / F.col("original"))
                           .otherwise(F.lit(0.0)).alias("retention"))


def fill_tag(items: DataFrame, column: str = "tag", value: str = "unknown") -> DataFrame:
    return items.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(value)))


def group_rare(items: DataFrame, minimum: int | None, column: str = "tag", label: str = "rare_tag") -> DataFrame:
    """Replace categories with fewer than ``minimum`` item rows by ``label``."""
    if minimum is None:
        return items
    counts = items.groupBy(column).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") < minimum)
    return (items.join(counts, column, "left")
            .withColumn(column, F.when(F.col("_c").isNotNull(), F.lit(label)).otherwise(F.col(column)))
            .select(*items.columns))


def item_popularity(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))


def value_shares(df: DataFrame, value) -> DataFrame:
    """Share of rows per value. The window runs over the few distinct values only."""
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("c"))
    return counts.select("value", (F.col("c") / df.agg(F.count(F.lit(1))).scalar()).alias("share"))


def distribution_shift(a: DataFrame, b: DataFrame, value) -> DataFrame:
    """Per value the two shares and their gap; half the summed gap is the total variation distance."""
    left = value_shares(a, value).withColumnRenamed("share", "share_a")
    right = value_shares(b, value).withColumnRenamed("share", "share_b")
    joined = left.join(right, "value", "full_outer").fillna(0.0, ["share_a", "share_b"])
    return joined.withColumn("gap", F.abs(F.col("share_a") - F.col("share_b")))
