"""Accuracy of ranked lists against relevant items.

A list is a top-k result, so what is gathered per user (the ranks of the hits) is at most k long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.numeric import discount, ideal_gain, ratio
from tastegrid.operators.ranking import dense_index, rank_within


def hit_table(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row per user of either table: list length, ranks of the hits, number of relevant items and rows."""
    rel = relevant.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_rows"))
    marked = recs.join(rel, ["user_id", "item_id"], "left")
    lists = marked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_recs"),
        F.array_sort(F.collect_list(F.when(F.col("_rows").isNotNull(), F.col("rank")))).alias("hit_ranks"))
    counts = rel.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rel"), F.sum("_rows").alias("n_rel_rows"))
    return (lists.join(counts, "user_id", "full_outer").fillna(0, ["n_recs", "n_rel", "n_rel_rows"])
            .withColumn("hit_ranks", F.coalesce("hit_ranks", F.array().cast("array<int>"))))


def _within(k: int) -> Column:
    return F.filter("hit_ranks", lambda r: r <= k)


def _gain(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + discount(r))


def precision_at_k(k: int) -> Column:
    """Hits in the first k over k."""
    return F.size(_within(k)) / F.lit(float(k)) if k > 0 else F.lit(0.0)


def recall_at_k(k: int) -> Column:
    return ratio(F.size(_within(k)).cast("double"), F.col("n_rel"))


def ndcg_list(k: int) -> Column:
    """Gain over the gain of the same hits moved to the front of the list."""
    return ratio(_gain(_within(k)), ideal_gain(F.size(_within(k))))


def ndcg_relevant(k: int) -> Column:
    """Gain over the gain of min(#relevant, k) hits."""
    return ratio(_gain(_within(k)), ideal_gain(F.least(F.col("n_rel"), F.lit(k))))


def average_precision() -> Column:
    """Mean over the relevant items of the precision at each hit, over the whole list."""
    terms = F.transform("hit_ranks", lambda r, i: (i + F.lit(1)) / r)
    return ratio(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x), F.col("n_rel"))


def reciprocal_rank() -> Column:
    first = F.get(F.col("hit_ranks"), F.lit(0))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def is_hit() -> Column:
    return (F.size("hit_ranks") > 0).cast("double")


def mean_over_users(per_user: DataFrame, **metrics: Column) -> DataFrame:
    return per_user.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(name) for name, m in metrics.items()])


def retrieval_per_user(recs: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """Evaluator's view per test user: precision over the list length, recall over the test rows."""
    users = test.select("user_id").distinct()
    hits = hit_table(recs.join(users, "user_id", "left_semi"), test)
    found = F.size("hit_ranks").cast("double")
    out = hits.select("user_id", ratio(found, F.col("n_recs")).alias("precision"),
                      ratio(found, F.col("n_rel_rows")).alias("recall"), is_hit().alias("hit"),
                      ndcg_relevant(k).alias("ndcg"), reciprocal_rank().alias("rr"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), both))


def retrieval_summary(per_user: DataFrame) -> DataFrame:
    names = {"precision": "avg_precision_at_k", "recall": "avg_recall_at_k", "f1": "avg_f1_at_k",
             "hit": "avg_hit_rate_at_k", "ndcg": "avg_ndcg_at_k", "rr": "avg_mrr"}
    return per_user.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in names.items()],
                        F.count(F.lit(1)).alias("num_users_evaluated"))


def ranking_per_user(scored: DataFrame, k: int) -> DataFrame:
    """Ranks of a user's own test rows (user_id, item_id, score) by score, ties by item.

    All of them are relevant. Ranks are counted in parts of the score's order, so a user with very
    many rows never meets in one task; the median is the mean of the one or two middle ranks.
    """
    falling = F.lit(0.5) - F.atan(F.col("score")) / F.lit(math.pi)   # between 0 and 1, falls as the score rises
    key = F.lpad(F.hex(F.floor(falling * F.lit(float((1 << 40) - 1))).cast("bigint")), 10, "0")
    order = [F.col("score").desc(), F.col("item_id")]
    ranked = rank_within(scored.withColumn("_key", key), ["user_id"], "_key", order, "_r", "_n")
    middle = (F.col("_r") * 2 >= F.col("_n")) & (F.col("_r") * 2 <= F.col("_n") + 2)
    within = F.col("_r") <= k
    ranks = ranked.groupBy("user_id").agg(
        F.max("_n").alias("n"), F.avg("_r").alias("avg_rank"), F.avg(F.when(middle, F.col("_r"))).alias("median_rank"),
        (F.lit(1.0) / F.min("_r")).alias("mrr"), F.avg(within.cast("double")).alias("hit_rate_at_k"),
        F.sum(F.when(within, discount(F.col("_r")))).alias("gain"))
    items = scored.select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("d"))
    best = ideal_gain(F.least(F.col("d"), F.lit(k)))
    return ranks.join(items, "user_id").select("user_id", "avg_rank", "median_rank", "mrr", "hit_rate_at_k",
                                               ratio(F.col("gain"), best).alias("ndcg_at_k"))


def ranking_summary(per_user: DataFrame) -> DataFrame:
    names = ("avg_rank", "median_rank", "mrr", "hit_rate_at_k", "ndcg_at_k")
    aggregates = [f(c).alias(f"{label}_{c}") for c in names for f, label in ((F.avg, "avg"), (F.stddev_pop, "std"))]
    return per_user.agg(*aggregates, F.count(F.lit(1)).alias("num_users_evaluated"))


def binary_metrics(scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 of score > threshold; 0 where undefined."""
    positive, truth = F.col(score) > threshold, F.col(label) == 1
    counts = scored.agg(F.count_if(positive & truth).alias("tp"), F.count_if(positive & ~truth).alias("fp"),
                        F.count_if(~positive & truth).alias("fn"), F.count_if(~positive & ~truth).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"), p.alias("precision"),
                         r.alias("recall"), ratio(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties counting half; 0.5 without one of the two.

    Rows are counted per score; the negatives below each score are running totals over range-partitioned scores, so no task
    holds the order of all rows.
    """
    truth = (F.col(label) == 1).cast("bigint")
    counts = scored.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(truth).alias("p"), F.sum(1 - truth).cast("double").alias("n"))
    placed = dense_index(counts, [F.col("s")], "_", weight="n")
    sums = placed.agg(F.sum(F.col("p") * (F.col("running") - F.col("n") / 2)).alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.coalesce(ratio(F.col("wins"), F.col("p") * F.col("n"), 0.5), F.lit(0.5)).alias("auc"))
