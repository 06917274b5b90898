"""Novelty, coverage and diversity of recommendation lists."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.vectors import as_doubles, dot, euclidean, unit
from tastegrid.operators.filtering import item_popularity
from tastegrid.operators.ranking import dense_index


def popularity_ranks(popularity: DataFrame) -> DataFrame:
    """(item_id, pop, pop_rank): 0 is the most popular, ties by item id."""
    return dense_index(popularity, [F.col("pop").desc(), F.col("item_id")], "pop_rank")


def novelty_rows(recs: DataFrame, ranks: DataFrame, history: DataFrame) -> DataFrame:
    """Recommendation rows with what the per-list measures need.

    self_info and iif are null for unknown items; the popularity rank of an unknown item is the
    number of items; ``fresh`` says the user has no history with the item.
    """
    totals = ranks.agg(F.struct(F.sum("pop").alias("rows"), F.count(F.lit(1)).alias("items"))).scalar()
    n_users = history.select("user_id").distinct().agg(F.count(F.lit(1))).scalar()
    in_history = item_popularity(history).withColumnRenamed("pop", "_hist")
    mine = history.select("user_id", "item_id").distinct().withColumn("_mine", F.lit(1))
    joined = (recs.join(ranks.select("item_id", "pop", "pop_rank"), "item_id", "left")
              .join(in_history, "item_id", "left").join(mine, ["user_id", "item_id"], "left")
              .withColumn("_t", totals).withColumn("_u", n_users))
    n_items = F.col("_t.items")
    chance = F.greatest(F.col("pop") / F.col("_t.rows"), F.lit(1e-10))
    return joined.select(
        "user_id", "item_id", (-F.log2(chance)).alias("self_info"),
        F.log(F.col("_u") / (F.col("_hist") + F.lit(1e-10))).alias("iif"),
        F.coalesce("pop_rank", n_items).cast("double").alias("pop_rank"),
        F.coalesce(F.col("pop_rank") >= F.floor(n_items * F.lit(0.2)), F.lit(False)).cast("double").alias("tail"),
        F.col("_mine").isNull().cast("double").alias("fresh"), n_items.alias("n_items"))


def novelty_per_user(rows: DataFrame) -> DataFrame:
    """All list measures of a user in one aggregation."""
    return rows.groupBy("user_id").agg(
        F.coalesce(F.avg("self_info"), F.lit(0.0)).alias("avg_self_information"),
        F.coalesce(F.avg("iif"), F.lit(0.0)).alias("avg_iif"),
        (F.count_distinct("item_id") / F.max("n_items")).alias("catalog_coverage"),
        F.avg("pop_rank").alias("avg_popularity_rank"), F.stddev_pop("pop_rank").alias("popularity_rank_std"),
        F.min("pop_rank").alias("min_popularity_rank"), F.max("pop_rank").alias("max_popularity_rank"),
        F.avg("tail").alias("long_tail_percentage"), F.avg("fresh").alias("personalized_novelty"))


def intra_list_similarity(recs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(user_id, n_vectors, ils): mean pairwise cosine of the list's items that have a vector.

    With unit vectors the sum over all pairs is (|sum|^2 - sum of |v|^2) / 2, so one vector sum per
    user replaces the pairs. Fewer than two vectors give 0.
    """
    units = embeddings.select("item_id", unit(as_doubles(F.col("embedding"))).alias("_v"))
    known = recs.select("user_id", "item_id").join(units, "item_id")
    sums = known.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_vectors"),
        Summarizer.sum(array_to_vector("_v")).alias("_sum"),
        F.sum(dot(F.col("_v"), F.col("_v"))).alias("_own"))
    total = vector_to_array("_sum")
    pairs = F.col("n_vectors") * (F.col("n_vectors") - 1)
    mean = F.when(pairs > 0, (dot(total, total) - F.col("_own")) / pairs).otherwise(F.lit(0.0))
    return sums.select("user_id", "n_vectors", mean.alias("ils"))


def pairwise_diversity(recs: DataFrame, embeddings: DataFrame, metric: str = "cosine") -> DataFrame:
    """(user_id, diversity): mean pairwise distance of the list's items that have a vector."""
    if metric == "cosine":
        return intra_list_similarity(recs, embeddings).select(
            "user_id", F.when(F.col("n_vectors") > 1, F.lit(1.0) - F.col("ils")).otherwise(F.lit(0.0)).alias("diversity"))
    if metric != "euclidean":
        raise ValueError(f"unknown distance: {metric}")
    # Euclidean distances have no closed sum: the list's pairs are joined, each summed where it is made.
    known = recs.select("user_id", "item_id", "rank").join(
        embeddings.select("item_id", as_doubles(F.col("embedding")).alias("v")), "item_id")
    left = known.select("user_id", F.col("rank").alias("p"), F.col("v").alias("a"))
    right = known.select("user_id", F.col("rank").alias("q"), F.col("v").alias("b"))
    pairs = left.join(right, "user_id").filter("p < q").groupBy("user_id").agg(F.avg(euclidean(F.col("a"), F.col("b"))).alias("d"))
    return known.select("user_id").distinct().join(pairs, "user_id", "left").select(
        "user_id", F.coalesce("d", F.lit(0.0)).alias("diversity"))


def coverage_diversity(recs: DataFrame) -> DataFrame:
    """Distinct recommended items over all recommendations."""
    per_item = recs.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    return per_item.agg(F.coalesce(F.count(F.lit(1)) / F.sum("c"), F.lit(0.0)).alias("coverage_diversity"))


def personalization(recs: DataFrame, users: DataFrame) -> DataFrame:
    """1 - mean pairwise cosine of the users' lists, without pairing users.

    With c the times u got i and N_u = sqrt(sum c^2), all ordered pairs with themselves sum to
    S = sum_i (sum_u c/N_u)^2, and each user with a list contributes 1 to it.
    """
    counts = recs.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("c"))
    norms = counts.groupBy("user_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    per_item = counts.join(norms, "user_id").groupBy("item_id").agg(F.sum(F.col("c") / F.col("n")).alias("s"))
    total = per_item.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0))).scalar()
    listed = norms.agg(F.count(F.lit(1))).scalar()
    u = F.col("u").cast("double")
    return (users.select("user_id").distinct().agg(F.count(F.lit(1)).alias("u"))
            .withColumn("_s", total).withColumn("_l", listed)
            .select(F.when(F.col("u") <= 1, F.lit(1.0))
                    .otherwise(F.lit(1.0) - (F.col("_s") - F.col("_l")) / (u * (u - 1))).alias("personalization")))


def serendipity(recs: DataFrame, expected: DataFrame, relevant: DataFrame, users: DataFrame) -> DataFrame:
    """Mean share of a list that is relevant and not expected; an empty list counts 0."""
    pair = ["user_id", "item_id"]
    rel = relevant.select(pair).distinct().withColumn("_rel", F.lit(1))
    exp = expected.select(pair).distinct().withColumn("_exp", F.lit(1))
    lucky = (F.col("_rel").isNotNull() & F.col("_exp").isNull()).cast("double")
    lists = recs.join(rel, pair, "left").join(exp, pair, "left").groupBy("user_id").agg(F.avg(lucky).alias("share"))
    return (users.select("user_id").distinct().join(lists, "user_id", "left")
            .agg(F.coalesce(F.avg(F.coalesce("share", F.lit(0.0))), F.lit(0.0)).alias("serendipity")))


def temporal_diversity(recs: DataFrame, item_times: DataFrame) -> DataFrame:
    """Mean over users of the population std of their items' times; unknown items count as time 0."""
    timed = recs.join(item_times, "item_id", "left").fillna(0.0, ["time"])
    per_user = timed.groupBy("user_id").agg(
        F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(F.stddev_pop("time")).alias("spread"))
    return per_user.agg(F.coalesce(F.avg("spread"), F.lit(0.0)).alias("temporal_diversity"))


def satisfaction_proxy(recs: DataFrame, item_features: DataFrame, preferences: DataFrame) -> DataFrame:
    """Mean over users of the mean cosine of preference and item on their common features.

    Both sides are long tables: (item_id, feature, value) and (user_id, feature, value).
    """
    pref = preferences.select("user_id", "feature", F.col("value").alias("p"))
    feat = item_features.select("item_id", "feature", F.col("value").alias("q"))
    both = recs.select("user_id", "item_id", "rank").join(feat, "item_id").join(pref, ["user_id", "feature"])
    cos = F.sum(F.col("p") * F.col("q")) / (
        F.sqrt(F.sum(F.col("p") * F.col("p"))) * F.sqrt(F.sum(F.col("q") * F.col("q"))) + F.lit(1e-8))
    per_item = both.groupBy("user_id", "item_id", "rank").agg(cos.alias("c"))
    per_user = per_item.groupBy("user_id").agg(F.avg("c").alias("c"))
    return per_user.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("satisfaction"))
