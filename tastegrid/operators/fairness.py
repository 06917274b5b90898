"""Distribution and fairness of recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gini(counts: DataFrame, column: str, name: str = "gini") -> DataFrame:
    """Gini coefficient 2*sum(i*x_i)/(n*sum x) - (n+1)/n over ascending counts.

    Equal counts are merged first: m equal values after C others hold the places C+1..C+m, which
    sum to m*C + m(m+1)/2. Counts adding up to N have at most sqrt(2N) different values, which is
    all the running sum has to go through.
    """
    hist = counts.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    before = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = hist.withColumn("c", F.coalesce(F.sum("m").over(before), F.lit(0.0)))
    places = F.col("m") * F.col("c") + F.col("m") * (F.col("m") + 1) / 2
    sums = placed.agg(F.sum(F.col("v") * places).alias("w"), F.sum("m").alias("n"), F.sum(F.col("v") * F.col("m")).alias("s"))
    value = F.lit(2.0) * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return sums.select(F.when(F.coalesce(F.col("s"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(value).alias(name))


def demographic_parity(recs: DataFrame, users: DataFrame, attribute: str) -> DataFrame:
    """Per group distinct recommended items over recommendations; users without one are 'unknown'."""
    groups = users.select("user_id", F.col(attribute).cast("string").alias("group"))
    grouped = recs.join(groups, "user_id", "left").fillna("unknown", ["group"])
    per_item = grouped.groupBy("group", "item_id").agg(F.count(F.lit(1)).alias("c"))
    return per_item.groupBy("group").agg((F.count(F.lit(1)) / F.sum("c")).alias("rate"))


def provider_counts(recs: DataFrame, providers: DataFrame) -> DataFrame:
    """Recommendations per provider; ``providers`` has one (item_id, provider) row per item."""
    per_item = recs.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    known = per_item.join(providers.select("item_id", "provider"), "item_id", "left").fillna("unknown", ["provider"])
    return known.groupBy("provider").agg(F.sum("c").alias("c"))


def provider_exposure(recs: DataFrame, providers: DataFrame) -> DataFrame:
    counts = provider_counts(recs, providers)
    total = recs.agg(F.count(F.lit(1))).scalar()
    return counts.select("provider", (F.col("c") / total).alias("exposure"))


def provider_gini(recs: DataFrame, providers: DataFrame) -> DataFrame:
    return gini(provider_counts(recs, providers), "c", "provider_gini")
