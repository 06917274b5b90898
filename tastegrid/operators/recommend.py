"""Set-based recommenders: (user_id, item_id, score, rank) for many users in one job.

Popularity counts come from all interactions; seen items and the neighbourhood models come from
the history. Scores are rounded to 9 places before ranking so that ties break by item id however
the sums were ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.hashing import hash_key, u01
from tastegrid.functions.vectors import as_doubles, dot
from tastegrid.operators.filtering import drop_seen, item_popularity, user_history
from tastegrid.operators.nearest import nearest
from tastegrid.operators.product import sparse_product
from tastegrid.operators.ranking import dense_index, small, top_k
from tastegrid.operators.sampling import index_catalog, steps, take_from_catalog
from tastegrid.operators.similarity import count_matrix, item_similarity, user_neighbors
from tastegrid.session import cut, stored

SEED = 42
PAIR_BUDGET = 1 << 20
FRONT = 256  # places of the popularity ranking, besides the list itself, that are looked at first


def _best():
    return [F.col("score").desc(), F.col("item_id")]


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rounded = scored.withColumn("score", F.round("score", 9))
    return top_k(rounded, ["user_id"], _best(), k).select("user_id", "item_id", "score", "rank")


@dataclass(frozen=True)
class RecommenderData:
    """Interactions (popularity, known users), catalog items, and the history to learn from and hide."""

    interactions: DataFrame
    items: DataFrame
    history: DataFrame

    @property
    def seen(self) -> DataFrame:
        return user_history(self.history)

    @property
    def model_rows(self) -> DataFrame:
        return self.history.join(self.items.select("item_id").distinct(), "item_id", "left_semi")


# ---------------------------------------------------------------- random

def recommend_random(data: RecommenderData, users: DataFrame, k: int = 10, filter_seen: bool = True,
                     candidates: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """k uniform draws per user; the score is the pair's own uniform number."""
    if candidates is not None:
        pool = candidates.select("user_id", "item_id").join(users.select("user_id"), "user_id", "left_semi")
        if filter_seen:
            pool = drop_seen(pool, data.seen)
        keyed = pool.withColumn("_key", hash_key("user_id", "item_id", seed=seed))
        drawn = top_k(keyed, ["user_id"], [F.col("_key")], k)
    else:
        need = users.select("user_id", F.lit(k).alias("m"))
        barred = data.seen.join(users.select("user_id"), "user_id", "left_semi") if filter_seen else data.seen.limit(0)
        drawn = take_from_catalog(need, index_catalog(data.items), barred, random=True, seed=seed)
    return drawn.select("user_id", "item_id", u01("user_id", "item_id", seed=seed).alias("score"), "rank")


def score_random(data: RecommenderData, pairs: DataFrame, seed: int = SEED) -> DataFrame:
    known = data.items.select("item_id").distinct().withColumn("_known", F.lit(1))
    score = F.when(F.col("_known").isNotNull(), u01("user_id", "item_id", seed=seed)).otherwise(F.lit(0.0))
    return pairs.join(known, "item_id", "left").withColumn("score", score).drop("_known")


# ---------------------------------------------------------------- popularity

def popularity_scores(data: RecommenderData) -> DataFrame:
    """(item_id, pop, score): catalog items with their count and the count over the largest count."""
    counted = cut(data.items.select("item_id").distinct()
                  .join(item_popularity(data.interactions), "item_id", "left").fillna(0, ["pop"]))
    top = counted.agg(F.greatest(F.max("pop"), F.lit(1))).scalar()
    return counted.withColumn("score", F.col("pop") / top)


def recommend_popularity(data: RecommenderData, users: DataFrame, k: int = 10, filter_seen: bool = True,
                         candidates: DataFrame | None = None) -> DataFrame:
    """Most popular unseen items. Seen items only count where they are in the front of the ranking, which grows until every
    user has k open items there, so the history isn't moved; only users who have seen some of them walk the ranking."""
    scores = popularity_scores(data)
    if candidates is not None:
        pool = candidates.select("user_id", "item_id").join(users.select("user_id"), "user_id", "left_semi")
        if filter_seen:
            pool = drop_seen(pool, data.seen)
        return _ranked(pool.join(scores.select("item_id", "score"), "item_id"), k)
    placed = dense_index(scores, [F.col("pop").desc(), F.col("item_id")], "pos")
    n = placed.count()
    asked = users.select("user_id").distinct()
    reach = k + FRONT
    while True:  # the front of the ranking, so long that every asked user has k open items in it
        front = small(placed.filter(F.col("pos") < reach).select("item_id", "pos", F.round("score", 9).alias("score")), reach)
        if not filter_seen:
            barred = data.history.select("user_id", "item_id").limit(0)
            break
        barred = cut(data.history.select("user_id", "item_id").join(front.select("item_id"), "item_id")
                     .join(asked, "user_id", "left_semi").select("user_id", "item_id").distinct())
        most = barred.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
        if reach >= n or reach - most >= k:
            break
        reach *= 8
    need = users.select("user_id", F.lit(k).alias("m"))
    touched = barred.select("user_id").distinct()
    walked = take_from_catalog(need.join(touched, "user_id", "left_semi"), front.select("item_id", "pos"), barred)
    taken = walked.join(front.select("item_id", "score"), "item_id").select("user_id", "item_id", "score", "rank")
    # users who have seen nothing of the front get its first k places
    others = steps(need.join(touched, "user_id", "left_anti").select("user_id", F.lit(min(k, n)).alias("_len")), "_len", "pos")
    first = others.join(front, "pos").select("user_id", "item_id", "score", (F.col("pos") + 1).cast("bigint").alias("rank"))
    return taken.unionByName(first)


def score_popularity(data: RecommenderData, pairs: DataFrame) -> DataFrame:
    scores = popularity_scores(data).select("item_id", "score")
    return pairs.join(scores, "item_id", "left").fillna(0.0, ["score"])


# ---------------------------------------------------------------- neighbourhood models

def _with_unknown(data: RecommenderData, users: DataFrame, known: DataFrame, k: int, filter_seen: bool,
                  candidates: DataFrame | None) -> DataFrame:
    """Users without any interaction get popular items instead."""
    strangers = users.select("user_id").join(data.interactions.select("user_id").distinct(), "user_id", "left_anti")
    if strangers.isEmpty():
        return known
    return known.unionByName(recommend_popularity(data, strangers, k, filter_seen, candidates))


def _fill_pool(data: RecommenderData, scored: DataFrame, users: DataFrame, k: int, filter_seen: bool,
               candidates: DataFrame | None) -> DataFrame:
    """Top k of the pool where items without a score count as 0 and ties go by item id."""
    seen = data.seen
    if candidates is not None:
        pool = (candidates.select("user_id", "item_id").join(users, "user_id", "left_semi")
                .join(data.items.select("item_id").distinct(), "item_id", "left_semi"))
        if filter_seen:
            pool = drop_seen(pool, seen)
        return _ranked(pool.join(scored, ["user_id", "item_id"], "left").fillna(0.0, ["score"]), k)
    open_scored = drop_seen(scored, seen) if filter_seen else scored
    best = cut(_ranked(open_scored, k))
    got = best.groupBy("user_id").agg(F.count(F.lit(1)).alias("_got"))
    short = (users.select("user_id").join(got, "user_id", "left").fillna(0, ["_got"])
             .filter(F.col("_got") < k).withColumn("m", F.lit(k) - F.col("_got")))
    if short.isEmpty():
        return best
    # a short user has fewer than k scored items, all of them in ``best``
    barred = best.select("user_id", "item_id")
    if filter_seen:
        barred = barred.unionByName(seen)
    barred = barred.join(short.select("user_id"), "user_id", "left_semi").distinct()
    padding = take_from_catalog(short.select("user_id", "m"), index_catalog(data.items), barred)
    padded = (padding.join(short.select("user_id", "_got"), "user_id")
              .select("user_id", "item_id", F.lit(0.0).alias("score"),
                      (F.col("_got") + F.col("rank")).cast("int").alias("rank")))
    return best.unionByName(padded)


def _item_knn_sums(history: DataFrame, similarity: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(user_id, item_id, v): summed similarity of an item to the user's history items.

    For given pairs a user costs #history * #pairs look-ups; users beyond PAIR_BUDGET go through
    the full product instead, which never holds a user whole.
    """
    left = history.select(F.col("user_id").alias("i"), F.col("item_id").alias("k"), F.lit(1.0).alias("x"))
    right = similarity.select(F.col("a").alias("k"), F.col("b").alias("j"), F.col("sim").alias("y"))

    def product(rows: DataFrame) -> DataFrame:
        return sparse_product(rows, right).select(F.col("i").alias("user_id"), F.col("j").alias("item_id"), "v")

    if pairs is None:
        return product(left)
    sizes = (history.groupBy("user_id").agg(F.count(F.lit(1)).alias("h"))
             .join(pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")), "user_id"))
    heavy = sizes.filter(F.col("h").cast("double") * F.col("c") > PAIR_BUDGET).select("user_id")
    hot = not heavy.isEmpty()
    easy = pairs.join(heavy, "user_id", "left_anti") if hot else pairs
    looked = (easy.join(history.select("user_id", F.col("item_id").alias("a")), "user_id")
              .join(similarity.select("a", F.col("b").alias("item_id"), "sim"), ["a", "item_id"])
              .groupBy("user_id", "item_id").agg(F.sum("sim").alias("v")))
    if not hot:
        return looked
    wide = product(left.join(heavy.select(F.col("user_id").alias("i")), "i", "left_semi"))
    return looked.unionByName(wide.join(pairs.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"))


def recommend_item_knn(data: RecommenderData, users: DataFrame, k: int = 10, filter_seen: bool = True,
                       candidates: DataFrame | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """Mean similarity to the user's history; items similar to none score 0 and fill up the list."""
    seen = data.seen
    active = users.select("user_id").join(seen.select("user_id").distinct(), "user_id", "left_semi")
    history = seen.join(active, "user_id", "left_semi")
    sim = similarity if similarity is not None else cut(item_similarity(data.model_rows, history, candidates))
    sums = _item_knn_sums(history, sim, None if candidates is None
                          else candidates.select("user_id", "item_id").distinct().join(active, "user_id", "left_semi"))
    lengths = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("_h"))
    scored = sums.join(lengths, "user_id").select("user_id", "item_id", (F.col("v") / F.col("_h")).alias("score"))
    known = _fill_pool(data, scored, active, k, filter_seen, candidates)
    return _with_unknown(data, users, known, k, filter_seen, candidates)


def score_item_knn(data: RecommenderData, pairs: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """Mean similarity over the history items of the catalog; 0 for unknown users or items."""
    wanted = pairs.select("user_id", "item_id").distinct()
    history = user_history(data.model_rows).join(wanted.select("user_id").distinct(), "user_id", "left_semi")
    sim = similarity if similarity is not None else cut(item_similarity(data.model_rows, history, wanted))
    sums = _item_knn_sums(history, sim, wanted)
    lengths = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("_h"))
    scored = sums.join(lengths, "user_id").select("user_id", "item_id", (F.col("v") / F.col("_h")).alias("score"))
    return pairs.join(scored, ["user_id", "item_id"], "left").fillna(0.0, ["score"])


def recommend_user_knn(data: RecommenderData, users: DataFrame, k: int = 10, filter_seen: bool = True,
                       candidates: DataFrame | None = None, k_neighbors: int = 50,
                       similarity: DataFrame | None = None) -> DataFrame:
    """Counts of the nearest users weighted by similarity; a user without neighbours gets none."""
    matrix = stored(count_matrix(data.model_rows))
    near = cut(_neighbors(matrix, users, k_neighbors, similarity))
    active = near.select("user_id").distinct()
    pairs = None if candidates is None else candidates.select("user_id", "item_id").distinct()
    scored = _user_knn_scores(near, matrix, pairs)
    known = _fill_pool(data, scored, active, k, filter_seen, candidates)
    return _with_unknown(data, users, known, k, filter_seen, candidates)


def _neighbors(matrix: DataFrame, users: DataFrame, k: int, similarity: DataFrame | None) -> DataFrame:
    """(user_id, neighbor, sim, rank) of the asked users, from a given similarity or searched for them alone."""
    asked = users.select("user_id").distinct()
    if similarity is not None:
        return user_neighbors(similarity, k).join(asked, "user_id", "left_semi")
    return nearest(matrix, "user_id", "item_id", asked, k)


def _user_knn_scores(near: DataFrame, matrix: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(user_id, item_id, score): counts of the neighbours weighted by similarity, of all their items or of the given pairs.

    Neighbours with equal rows are one, their similarities summed. A row travels to the users it is near to packed, and users
    are dealt out once, pairs beside the rows; so a product is made where it is summed and none is shuffled.
    """
    packed = (matrix.filter(F.col("user_id").isNotNull()).groupBy("user_id")
              .agg(F.array_sort(F.collect_list(F.struct("item_id", "c"))).alias("v")))
    packed = stored(packed.withColumn("r", F.sha2(F.to_json("v"), 256)))
    rows = packed.groupBy("r").agg(F.min("user_id").alias("user_id")).join(packed.select("user_id", "v"), "user_id").select("r", "v")
    merged = (near.join(packed.select(F.col("user_id").alias("neighbor"), "r"), "neighbor")
              .groupBy("user_id", "r").agg(F.sum("sim").alias("w")))
    dealt = merged.join(rows, "r").select("user_id", "w", F.col("v.item_id").alias("items"), F.col("v.c").alias("counts"))
    if pairs is not None:
        asked = pairs.join(near.select("user_id").distinct(), "user_id", "left_semi")
        dealt = dealt.unionByName(asked.select("user_id", F.lit(None).cast("double").alias("w"), F.array("item_id").alias("items"),
                                               F.array(F.lit(0).cast("bigint")).alias("counts")))
    dealt = dealt.repartition("user_id")
    entries = dealt.select("user_id", "w", F.inline(F.arrays_zip("items", "counts")).alias("item_id", "c"))
    sums = entries.groupBy("user_id", "item_id").agg(
        F.coalesce(F.sum(F.col("w") * F.col("c")), F.lit(0.0)).alias("v"), F.bool_or(F.col("w").isNull()).alias("asked"))
    if pairs is not None:
        sums = sums.filter("asked")
    weights = near.groupBy("user_id").agg(F.sum("sim").alias("_w"))
    return sums.join(weights, "user_id").select("user_id", "item_id", (F.col("v") / F.col("_w")).alias("score"))


def score_user_knn(data: RecommenderData, pairs: DataFrame, k_neighbors: int = 50,
                   similarity: DataFrame | None = None) -> DataFrame:
    matrix = stored(count_matrix(data.model_rows))
    near = cut(_neighbors(matrix, pairs, k_neighbors, similarity))
    scored = _user_knn_scores(near, matrix, pairs.select("user_id", "item_id").distinct())
    return pairs.join(scored, ["user_id", "item_id"], "left").fillna(0.0, ["score"])


# ---------------------------------------------------------------- model scores

Scorer = Callable[[DataFrame], DataFrame]


def recommend_model(data: RecommenderData, users: DataFrame, k: int = 10, filter_seen: bool = True,
                    candidates: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Top k of the candidates by any scorer, a function adding ``score`` to (user_id, item_id).

    Users and items must be known; pairs the scorer leaves null score 0. Without candidates every
    user's whole catalog is scored, which is as many pairs as users times items: for a dot product
    ``dot_top_k`` finds the same lists block by block.
    """
    if scorer is None:
        raise ValueError("a model recommender needs a scorer")
    if candidates is None:
        catalog = index_catalog(data.items)
        walked = steps(users.select("user_id", F.lit(catalog.count()).alias("_len")), "_len", "pos")
        candidates = walked.join(catalog, "pos").select("user_id", "item_id")
    known_users = users.select("user_id").join(data.interactions.select("user_id").distinct(), "user_id", "left_semi")
    pool = (candidates.select("user_id", "item_id").distinct().join(known_users, "user_id", "left_semi")
            .join(data.items.select("item_id").distinct(), "item_id", "left_semi"))
    if filter_seen:
        pool = drop_seen(pool, data.seen)
    return _ranked(scorer(pool).fillna(0.0, ["score"]), k)


def score_model(data: RecommenderData, pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """Model score per pair; 0 for an unknown user or item."""
    known = (pairs.select("user_id", "item_id").distinct()
             .join(data.interactions.select("user_id").distinct(), "user_id", "left_semi")
             .join(data.items.select("item_id").distinct(), "item_id", "left_semi"))
    return pairs.join(scorer(known).select("user_id", "item_id", "score"), ["user_id", "item_id"], "left").fillna(0.0, ["score"])


def dot_scorer(user_vectors: DataFrame, item_vectors: DataFrame) -> Scorer:
    """Dot product of (user_id, vector) and (item_id, vector); null where either is missing."""

    def score(pairs: DataFrame) -> DataFrame:
        u = user_vectors.select("user_id", as_doubles(F.col("vector")).alias("_u"))
        v = item_vectors.select("item_id", as_doubles(F.col("vector")).alias("_v"))
        return (pairs.join(u, "user_id", "left").join(v, "item_id", "left")
                .withColumn("score", F.when(F.col("_u").isNotNull() & F.col("_v").isNotNull(), dot(F.col("_u"), F.col("_v"))))
                .drop("_u", "_v"))

    return score


USER_BLOCK, ITEM_BLOCK = 1024, 4096


def dot_top_k(data: RecommenderData, user_vectors: DataFrame, item_vectors: DataFrame, k: int = 10,
              filter_seen: bool = True) -> DataFrame:
    """Exact top k over the whole catalog by dot product, without pairing users with items.

    Items are laid out in blocks by falling length of their vectors. No item of a block or behind it scores more than the
    user's length times the block's greatest (Cauchy-Schwarz), so a user stops as soon as the k-th best score so far is above
    that. Rounds visit 1, 2, 4, .. further blocks; a cell of one block and some users keeps k unseen items per user, so scored
    pairs never leave the task. Catalog items without a vector score 0 and take part from the start.
    """
    seen = data.seen.select("user_id", "item_id")
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    catalog = data.items.select("item_id").distinct()
    users = user_vectors.select("user_id", as_doubles(F.col("vector")).alias("u"))
    users = cut(users.withColumn("reach", length(F.col("u"))))
    vectors = item_vectors.join(catalog, "item_id", "left_semi").select("item_id", as_doubles(F.col("vector")).alias("v"))
    vectors = vectors.withColumn("length", length(F.col("v")))
    placed = dense_index(vectors, [F.col("length").desc(), F.col("item_id")], "pos")
    items = cut(placed.select("item_id", "v", "length", F.floor(F.col("pos") / ITEM_BLOCK).cast("bigint").alias("block")))
    longest = items.groupBy("block").agg(F.max("length").alias("longest"))
    blocks = longest.count()

    need = users.select("user_id", F.lit(k).alias("m"))
    barred = seen.join(need, "user_id", "left_semi") if filter_seen else seen.limit(0)
    bare = index_catalog(catalog.join(items.select("item_id"), "item_id", "left_anti"))
    best = cut(take_from_catalog(need, bare, barred).select("user_id", "item_id", F.lit(0.0).alias("score")))
    hidden = barred.join(items.select("item_id", "block"), "item_id").select("user_id", "item_id", "block")
    open_users, start, width = users, 0, 1
    while start < blocks:
        stop = min(start + width, blocks)
        parts = -(-open_users.count() // USER_BLOCK) or 1  # every open user visits every block of the round
        visits = open_users.select("user_id", "u", F.explode(F.sequence(
            F.lit(start).cast("bigint"), F.lit(stop - 1).cast("bigint"))).alias("block"))
        found = _visited(visits, items.filter(F.col("block").between(start, stop - 1)),
                         hidden.filter(F.col("block").between(start, stop - 1)), parts, k)
        best = cut(_ranked(best.unionByName(found), k).select("user_id", "item_id", "score"))
        start, width = stop, width * 2
        if start < blocks:
            bound = longest.filter(F.col("block") == start).select(F.max("longest")).scalar()
            held = best.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("least"))
            left = open_users.join(held, "user_id", "left").withColumn("_bound", bound)
            open_users = cut(left.filter(F.col("held").isNull() | (F.col("held") < k) | (
                F.col("reach") * F.col("_bound") * (1 + 1e-12) + 1e-8 >= F.col("least"))).select("user_id", "u", "reach"))
            if open_users.isEmpty():
                break
    return _ranked(best, k)


def _visited(visits: DataFrame, items: DataFrame, hidden: DataFrame, parts: int, k: int) -> DataFrame:
    """The k best unseen items of each visited block per user: (user_id, item_id, score)."""
    part = F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int").alias("part")
    asked = visits.select(F.col("block").alias("b"), part, "user_id", F.col("u").alias("x"), F.lit(None).cast("string").alias("item_id"))
    out = hidden.join(visits.select("user_id", "block"), ["user_id", "block"], "left_semi").select(
        F.col("block").alias("b"), part, "user_id", F.lit(None).cast("array<double>").alias("x"), "item_id")
    there = items.select(F.col("block").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                         F.col("item_id").alias("item"), F.col("v").alias("y"))

    def best(_cell: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        who = left[left["item_id"].isna()]
        if who.empty or right.empty:
            return pd.DataFrame({"user_id": pd.Series(dtype=str), "item_id": pd.Series(dtype=str), "score": pd.Series(dtype=float)})
        right = right.sort_values("item")
        ids, names = right["item"].to_numpy(), who["user_id"].to_numpy()
        scores = np.round(np.stack(who["x"].to_numpy()) @ np.stack(right["y"].to_numpy()).T, 9)
        seen = left[left["item_id"].notna()]
        scores[pd.Index(names).get_indexer(seen["user_id"]), pd.Index(ids).get_indexer(seen["item_id"])] = -np.inf
        least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(names), -np.inf)
        row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))  # the k best and ties with the last of them
        order = np.lexsort((at, -scores[row, at], row))
        row, at = row[order], at[order]
        near = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, at = row[near], at[near]
        return pd.DataFrame({"user_id": names[row], "item_id": ids[at], "score": scores[row, at]})

    cells = asked.unionByName(out).groupBy("b", "part").cogroup(there.groupBy("b", "part"))
    return cells.applyInPandas(best, "user_id string, item_id string, score double")


# ---------------------------------------------------------------- selection by name

RECOMMENDERS = {"random": recommend_random, "popularity": recommend_popularity,
                "item_knn": recommend_item_knn, "user_knn": recommend_user_knn, "multimodal": recommend_model}
SCORERS = {"random": score_random, "popularity": score_popularity,
           "item_knn": score_item_knn, "user_knn": score_user_knn, "multimodal": score_model}


def recommender(name: str) -> Callable[..., DataFrame]:
    if name not in RECOMMENDERS:
        raise ValueError(f"unknown recommender: {name}")
    return RECOMMENDERS[name]


def pair_scorer(name: str) -> Callable[..., DataFrame]:
    if name not in SCORERS:
        raise ValueError(f"unknown recommender: {name}")
    return SCORERS[name]


def nest(recs: DataFrame) -> DataFrame:
    """One row per user with the ranked list of (item_id, score); lists are at most k long."""
    entry = F.struct("rank", "item_id", "score")
    return (recs.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
            .select("user_id", F.transform("_l", lambda e: F.struct(e["item_id"].alias("item_id"),
                                                                    e["score"].alias("score"))).alias("recommendations")))
