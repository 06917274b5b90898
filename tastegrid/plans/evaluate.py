"""Evaluators: candidates, scores, lists and all metrics of a recommender as one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.operators import accuracy, novelty
from tastegrid.operators.filtering import item_popularity
from tastegrid.operators.recommend import RecommenderData, pair_scorer, recommender
from tastegrid.operators.sampling import eval_candidates
from tastegrid.session import cut

METHODS = {"sampled": "negative_sampling", "positives": "full_evaluation", "catalog": "catalog_evaluation"}
REMOVED_TASKS = ("next_item", "cold_user", "cold_item", "beyond_accuracy", "session_based")


def retrieval_recs(data: RecommenderData, test: DataFrame, name: str, k: int, mode: str = "sampled",
                   negatives: int = 100, strategy: str = "random", seed: int = 42, **options) -> DataFrame:
    """Lists for the test users. Seen items stay in: the positives must be able to appear."""
    if mode not in METHODS:
        raise ValueError(f"unknown candidate mode: {mode}")
    users = test.select("user_id").distinct()
    pairs = None
    if mode == "sampled":
        pairs = eval_candidates(test, data.items, negatives, strategy, seed).select("user_id", "item_id")
    elif mode == "positives":
        pairs = test.select("user_id", "item_id").distinct()
    return recommender(name)(data, users, k=k, filter_seen=False, candidates=pairs, **options)


def evaluate_retrieval(data: RecommenderData, test: DataFrame, name: str, k: int = 20, mode: str = "sampled",
                       negatives: int = 100, strategy: str = "random", embeddings: DataFrame | None = None,
                       seed: int = 42, **options) -> DataFrame:
    """One row: accuracy averaged over all test users, novelty over users with a list, and the method."""
    recs = cut(retrieval_recs(data, test, name, k, mode, negatives, strategy, seed, **options))
    found = accuracy.retrieval_summary(accuracy.retrieval_per_user(recs, test, k))
    ranks = novelty.popularity_ranks(item_popularity(data.interactions))
    lists = novelty.novelty_per_user(novelty.novelty_rows(recs, ranks, data.interactions))
    if embeddings is not None:
        lists = lists.join(novelty.intra_list_similarity(recs, embeddings).select("user_id", "ils"), "user_id", "left")
        lists = lists.fillna(0.0, ["ils"])
    else:
        lists = lists.withColumn("ils", F.lit(None).cast("double"))
    averages = lists.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (
        ("avg_self_information", "avg_self_information"), ("avg_iif", "avg_iif"),
        ("catalog_coverage", "avg_catalog_coverage"), ("ils", "avg_intra_list_similarity"),
        ("personalized_novelty", "avg_personalized_novelty"))])
    apart = novelty.personalization(recs, test).select(F.col("personalization").alias("avg_personalization"))
    return (found.withColumn("_n", averages.select(F.struct("*")).scalar())
            .withColumn("avg_personalization", apart.scalar())
            .select(*found.columns, "_n.*", "avg_personalization", F.lit(METHODS[mode]).alias("evaluation_method")))


def evaluate_ranking(data: RecommenderData, test: DataFrame, name: str, k: int = 20, **options) -> DataFrame:
    """One row: mean and population std over users of the ranks that the recommender's scores give their own test rows."""
    scored = pair_scorer(name)(data, test.select("user_id", "item_id"), **options)
    return accuracy.ranking_summary(accuracy.ranking_per_user(scored, k))


EVALUATORS = {"retrieval": evaluate_retrieval, "ranking": evaluate_ranking}


def evaluator(task: str) -> Callable[..., DataFrame]:
    if task in REMOVED_TASKS:
        raise ValueError(f"task no longer supported: {task}")
    if task not in EVALUATORS:
        raise ValueError(f"unknown task: {task}")
    return EVALUATORS[task]
