"""Recommenders, metrics, novelty, fairness and losses with hand-computed values."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import accuracy, fairness, losses, novelty, scorer
from tastegrid.operators import recommend as rec
from tastegrid.plans import evaluate


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


PAIR = "user_id string, item_id string"


@pytest.fixture(scope="module")
def data(spark):
    rows = [("u1", "i1"), ("u1", "i2"), ("u1", "i3"), ("u2", "i2"), ("u2", "i3"), ("u3", "i4"), ("u4", "i1"), ("u4", "i3")]
    inter = table(spark, rows, PAIR)
    return rec.RecommenderData(inter, inter.select("item_id").distinct(), inter)


def users(spark, *ids):
    return table(spark, [(u,) for u in ids], "user_id string")


def listed(df):
    out = {}
    for r in df.orderBy("user_id", "rank").collect():
        out.setdefault(r.user_id, []).append(r.item_id)
    return out


def test_popularity(spark, data):
    got = rec.recommend_popularity(data, users(spark, "u1"), 10, filter_seen=False).orderBy("rank").collect()
    assert (got[0].item_id, got[0].score) == ("i3", 1.0)
    assert listed(rec.recommend_popularity(data, users(spark, "u1"), 10)) == {"u1": ["i4"]}


def test_neighbourhood_models(spark, data):
    assert listed(rec.recommend_item_knn(data, users(spark, "u2"), 1))["u2"] == ["i1"]
    assert listed(rec.recommend_user_knn(data, users(spark, "u2"), 1))["u2"] == ["i1"]
    assert listed(rec.recommend_user_knn(data, users(spark, "u3"), 1)) == {}
    assert rec.score_user_knn(data, table(spark, [("u3", "i1")], PAIR)).first().score == 0.0


def test_both_routes_of_the_pair_budget(spark, data, monkeypatch):
    pairs = table(spark, [(u, i) for u in ("u1", "u2", "u4") for i in ("i1", "i2", "i3", "i4")], PAIR)
    run = lambda: {(r.user_id, r.item_id): round(r.score, 9) for r in rec.score_item_knn(data, pairs).collect()}
    looked = run()
    monkeypatch.setattr(rec, "PAIR_BUDGET", 1)
    assert run() == looked


def test_random_lists(spark, data):
    got = listed(rec.recommend_random(data, users(spark, "u1", "u2"), 2))
    assert got["u1"] == ["i4"] and set(got["u2"]) == {"i1", "i4"}


def test_model_on_catalog_and_candidates(spark):
    inter = table(spark, [("u1", "i1"), ("u1", "i2"), ("u2", "i3")], PAIR)
    data = rec.RecommenderData(inter, table(spark, [(f"i{n}",) for n in range(1, 6)], "item_id string"), inter)
    scorer = lambda df: df.withColumn("score", 1 - (F.substring("item_id", 2, 1).cast("int") - 1) / 10)
    run = lambda u, **o: listed(rec.recommender("multimodal")(data, users(spark, u), scorer=scorer, k=3, **o))
    assert run("u1", filter_seen=False) == {"u1": ["i1", "i2", "i3"]}
    assert run("u1") == {"u1": ["i3", "i4", "i5"]}
    few = table(spark, [("u1", i) for i in ("i1", "i4", "i5")], PAIR)
    assert run("u1", filter_seen=False, candidates=few) == {"u1": ["i1", "i4", "i5"]}
    assert run("nobody") == {}
    with pytest.raises(ValueError):
        rec.recommender("absent")


@pytest.mark.parametrize("block", [1024, 8])
def test_dot_products_over_the_whole_catalog(spark, monkeypatch, block):
    """Against all pairs: long and short vectors, negative scores, items without a vector, seen items, several blocks."""
    monkeypatch.setattr(rec, "ITEM_BLOCK", block)
    monkeypatch.setattr(rec, "USER_BLOCK", 5)
    rng = np.random.default_rng(3)
    items = {f"i{n:03}": [float(x) for x in rng.normal(size=3) * (10 if n < 20 else 0.5)] for n in range(90)}
    people = {f"u{n}": [float(x) for x in rng.normal(size=3)] for n in range(12)}
    bare = ["j1", "j2", "j3"]
    seen = [(f"u{n}", f"i{m:03}") for n in range(12) for m in range(n, 40, 3)] + [("u0", "j1")]
    inter = table(spark, seen, PAIR)
    data = rec.RecommenderData(inter, table(spark, [(i,) for i in [*items, *bare]], "item_id string"), inter)
    vectors = lambda d, name: table(spark, list(d.items()), f"{name} string, vector array<double>")
    for hide in (True, False):
        want = set()
        for u, x in people.items():
            scores = {i: round(float(np.dot(x, v)), 9) for i, v in items.items()} | dict.fromkeys(bare, 0.0)
            pool = [i for i in scores if not hide or (u, i) not in seen]
            want |= {(u, i, r + 1) for r, i in enumerate(sorted(pool, key=lambda i: (-scores[i], i))[:7])}
        got = rec.dot_top_k(data, vectors(people, "user_id"), vectors({**items, "absent": [99.0, 99.0, 99.0]}, "item_id"), 7, hide)
        assert {(r.user_id, r.item_id, r["rank"]) for r in got.collect()} == want


def hits(spark, recs, relevant):
    lists = table(spark, [("u", i, n + 1) for n, i in enumerate(recs)], "user_id string, item_id string, rank int")
    return accuracy.hit_table(lists, table(spark, [("u", i) for i in relevant], PAIR))


def test_list_metrics(spark):
    h = hits(spark, ["a", "b", "c", "d", "e"], ["a", "c", "e"])
    got = h.select(accuracy.precision_at_k(3).alias("p3"), accuracy.precision_at_k(10).alias("p10"), accuracy.recall_at_k(3).alias("r3"),
                   accuracy.average_precision().alias("ap"), accuracy.reciprocal_rank().alias("rr"), accuracy.ndcg_list(5).alias("n")).first()
    assert got.p3 == pytest.approx(2 / 3) and got.p10 == pytest.approx(0.3) and got.r3 == pytest.approx(2 / 3)
    assert got.ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3) and got.rr == 1
    gain = lambda ranks: sum(1 / math.log2(r + 1) for r in ranks)
    assert got.n == pytest.approx(gain((1, 3, 5)) / gain((1, 2, 3)))
    none = hits(spark, ["x"], ["a"]).select(accuracy.average_precision(), accuracy.reciprocal_rank(), accuracy.ndcg_list(5)).first()
    assert tuple(none) == (0, 0, 0)


def test_retrieval_summary(spark):
    recs = table(spark, [(u, i, n + 1) for u in ("u1", "u2") for n, i in enumerate(("item4", "item2"))], "user_id string, item_id string, rank int")
    test = table(spark, [("u1", "item2"), ("u2", "item3")], PAIR)
    got = accuracy.retrieval_summary(accuracy.retrieval_per_user(recs, test, 2)).first()
    assert (got.avg_precision_at_k, got.avg_recall_at_k, got.avg_mrr) == (0.25, 0.5, 0.25)


def test_ranking_of_test_rows(spark):
    scored = table(spark, [("u1", f"i{n}", n / 10) for n in (5, 2, 8)] + [("u2", f"j{n}", 0.0) for n in range(4)],
                   "user_id string, item_id string, score double")
    got = {r.user_id: tuple(r)[1:] for r in accuracy.ranking_per_user(scored, 5).collect()}
    assert got["u1"] == pytest.approx((2, 2, 1, 1, 1)) and got["u2"] == pytest.approx((2.5, 2.5, 1, 1, 1))


def test_evaluators(spark, data):
    assert evaluate.evaluator("ranking")(data, data.interactions, "popularity", k=2).first().num_users_evaluated == 4
    scorer = lambda df: df.withColumn("score", F.lit(0.5))
    got = evaluate.evaluator("retrieval")(data, data.interactions, "multimodal", k=2, mode="catalog", scorer=scorer).first()
    assert got.evaluation_method == "catalog_evaluation"
    for name in ("next_item", "absent"):
        with pytest.raises(ValueError):
            evaluate.evaluator(name)


def test_diversity(spark):
    recs = table(spark, [("u", i, n + 1) for n, i in enumerate("abcd")] + [("v", "a", 1), ("w", "a", 1), ("w", "c", 2)],
                 "user_id string, item_id string, rank int")
    vectors = table(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0]), ("d", [-1.0, 0.0])], "item_id string, embedding array<double>")
    cos = {r.user_id: r.diversity for r in novelty.pairwise_diversity(recs, vectors).collect()}
    assert cos["v"] == 0 and cos["w"] == pytest.approx(0) and cos["u"] == pytest.approx((1 + 0 + 2 + 1 + 1 + 2) / 6)
    far = {r.user_id: r.diversity for r in novelty.pairwise_diversity(recs, vectors, "euclidean").collect()}
    assert far["v"] == 0 and far["u"] == pytest.approx((3 * math.sqrt(2) + 0 + 2 + 2) / 6)
    assert novelty.coverage_diversity(recs).first()[0] == pytest.approx(4 / 7)


def test_gini_and_fairness(spark):
    gini = lambda *c: fairness.gini(table(spark, [(x,) for x in c], "c int"), "c").first().gini
    assert gini(5, 5, 5, 5) == pytest.approx(0) and gini(0, 0, 0, 10) == pytest.approx(0.75)
    recs = table(spark, [("u1", "a"), ("u1", "b"), ("u2", "a"), ("u3", "a"), ("u4", "c")], PAIR)
    people = table(spark, [("u1", "x"), ("u2", "x"), ("u3", "y")], "user_id string, g string")
    rates = {r.group: r.rate for r in fairness.demographic_parity(recs, people, "g").collect()}
    assert rates == {"x": pytest.approx(2 / 3), "y": 1, "unknown": 1}
    owners = table(spark, [("a", "p"), ("b", "q")], "item_id string, provider string")
    assert {r.provider: r.exposure for r in fairness.provider_exposure(recs, owners).collect()} == {"p": 0.6, "q": 0.2, "unknown": 0.2}


def test_losses(spark):
    got = losses.bce_loss(table(spark, [(1.0, 0.9), (0.0, 0.2)], "label double, score double")).first().bce
    assert got == pytest.approx(-(math.log(0.9) + math.log(0.8)) / 2)
    eye = [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]
    loss = lambda right: losses.contrastive_alignment(table(spark, [(str(i), eye[i], right[i]) for i in range(4)],
                                                            "item_id string, a array<double>, b array<double>"), "a", "b", 0.1, 4).first().loss
    assert loss(eye) < 0.01 and loss(eye[::-1]) == pytest.approx(10, abs=0.1)


def test_binary_metrics(spark):
    df = table(spark, [(1, 0.9), (1, 0.2), (0, 0.7), (0, 0.1)], "label int, score double")
    assert tuple(accuracy.binary_metrics(df).first()) == (0.5, 0.5, 0.5, 0.5)


def test_auc_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(y), round(float(x), 1)) for y, x in zip(rng.integers(0, 2, 90), rng.random(90))] + [(1, None)]
    wins = [(a > b) + (a == b) / 2 for y, a in rows[:-1] if y for z, b in rows[:-1] if not z]
    assert accuracy.roc_auc(table(spark, rows, "label int, score double")).first().auc == pytest.approx(sum(wins) / len(wins))
    assert accuracy.roc_auc(table(spark, [(1, 0.5)], "label int, score double")).first().auc == 0.5
    assert accuracy.roc_auc(table(spark, [], "label int, score double")).first().auc == 0.5


def test_scorer_finds_a_planted_signal_in_held_out_pairs(spark):
    """Users like items of their own colour: seen in held-out pairs, unknown users included."""
    rows = [(f"u{u}", f"i{i}", float((u + i) % 2 == 0), [float(u % 2 * 2 - 1) * float(i % 2 * 2 - 1), 1.0]) for u in range(40) for i in range(30)]
    samples = table(spark, rows, "user_id string, item_id string, label double, x array<double>")
    train, held = scorer.split_samples(samples)
    assert 150 < held.count() < 330 and train.count() + held.count() == 1_200
    assert not held.join(train, ["user_id", "item_id"]).count()
    for kind in ("fm", "logistic"):
        model = scorer.fit_scorer(train, ["user_id", "item_id"], ["x"], kind, buckets=256, factors=2, iterations=25)
        scored = scorer.apply_scorer(model, held.withColumn("user_id", F.when(F.col("user_id") == "u3", "new").otherwise(F.col("user_id"))),
                                     ["user_id", "item_id"], ["x"])
        assert accuracy.roc_auc(scored).first().auc > 0.9
    with pytest.raises(ValueError):
        scorer.fit_scorer(train, ["user_id"], ["x"], "absent")


def test_batches_do_not_depend_on_the_parts_that_rank_them(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"i{n}", [float(x) for x in rng.normal(size=4)], [float(x) for x in rng.normal(size=4)]) for n in range(70)]
    df = table(spark, rows, "item_id string, a array<double>, b array<double>")
    run = lambda: {r.batch_id: (r.rows, round(r.loss, 9)) for r in losses.contrastive_alignment(df, "a", "b", 0.1, 8).collect()}
    whole = run()
    assert [n for n, _ in (whole[b] for b in sorted(whole))] == [8] * 8 + [6]
    monkeypatch.setattr(losses, "BATCHES", 1)
    assert run() == whole


@pytest.mark.parametrize("front", [0, 3, 256])
def test_popular_lists_move_only_what_lies_in_the_front(spark, monkeypatch, front):
    rows = [(f"u{n % 9}", f"i{n % (5 + n % 9):02}") for n in range(200)] + [("long", f"i{n:02}") for n in range(12)] + [("odd", "i39")]
    inter = spark.createDataFrame(rows, "user_id string, item_id string")
    catalog = spark.createDataFrame([(f"i{n:02}",) for n in range(40)], "item_id string")
    given = rec.RecommenderData(inter, catalog, inter)
    walked = []
    whole = rec.take_from_catalog
    monkeypatch.setattr(rec, "FRONT", front)
    monkeypatch.setattr(rec, "take_from_catalog", lambda need, *more: walked.append({r.user_id for r in need.collect()}) or whole(need, *more))
    asked = [*(f"u{n}" for n in range(9)), "long", "odd", "nobody"]
    got = listed(rec.recommend_popularity(given, users(spark, *asked), 4))
    ranking = sorted((f"i{n:02}" for n in range(40)), key=lambda i: (-sum(r[1] == i for r in rows), i))
    assert got == {u: [i for i in ranking if (u, i) not in rows][:4] for u in asked}
    assert "nobody" not in walked[0] and "long" in walked[0]  # seen nothing: the first places, without a walk


def test_taste_vectors_are_not_shuffled(spark, folder):
    from tastegrid.plans.bindings import Views
    from tastegrid.plans.queries import _taste

    v = Views(spark, folder)
    plan = _taste(v, v.clicks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_user_knn_products_stay_with_their_user(spark):
    counts = {"a": {"i1": 2, "i2": 1}, "b": {"i1": 2, "i2": 1}, "c": {"i2": 3, "i3": 1}, "d": {"i4": 5}}  # a and b have equal rows
    near = {"u": {"a": 0.5, "b": 0.25, "c": 0.25}, "v": {"c": 1.0}, "w": {"a": 0.125, "d": 0.375}}
    pairs = [("u", "i1"), ("u", "i4"), ("v", "none"), ("v", "i3"), ("stranger", "i1")]
    score = lambda u, i: sum(s * counts[n].get(i, 0) for n, s in near[u].items()) / sum(near[u].values())
    matrix = table(spark, [(u, i, c) for u, row in counts.items() for i, c in row.items()], "user_id string, item_id string, c bigint")
    lists = table(spark, [(u, n, s) for u, row in near.items() for n, s in row.items()], "user_id string, neighbor string, sim double")
    every = {(u, i): score(u, i) for u in near for i in {i for n in near[u] for i in counts[n]}}
    got = rec._user_knn_scores(lists, matrix, None)
    assert {(r.user_id, r.item_id): r.score for r in got.collect()} == every
    asked = rec._user_knn_scores(lists, matrix, table(spark, pairs, PAIR))
    assert {(r.user_id, r.item_id): r.score for r in asked.collect()} == {(u, i): score(u, i) for u, i in pairs if u in near}
    for df in (got, asked):  # no (user, item) product is shuffled
        assert "hashpartitioning(user_id, item_id" not in re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_blocks_of_dot_products_are_dealt_without_a_join_by_block(spark):
    """All visits of a block would meet in one task. Ties with the k-th score go by item, seen items and short blocks too."""
    vectors = {f"i{n:02}": [float(n % 4), 1.0] for n in range(30)}
    people = {f"u{n}": [float(n % 3), 0.5] for n in range(9)}
    visits = table(spark, [(u, x, 0) for u, x in people.items()], "user_id string, u array<double>, block bigint")
    items = lambda count: table(spark, [(i, v, 0) for i, v in list(vectors.items())[:count]], "item_id string, v array<double>, block bigint")
    seen = {(f"u{n}", f"i{m:02}") for n in range(9) for m in range(n, 30, 5)}
    hidden = lambda count: table(spark, [(u, i, 0) for u, i in seen if i < f"i{count:02}"], "user_id string, item_id string, block bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rec._visited(visits, items(30), hidden(30), 3, 6)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(block" not in plan
    for count in (30, 6, 4):
        want = set()
        for u, x in people.items():
            open_items = [i for i in list(vectors)[:count] if (u, i) not in seen]
            score = lambda i: round(float(np.dot(x, vectors[i])), 9)
            want |= {(u, i, score(i)) for i in sorted(open_items, key=lambda i: (-score(i), i))[:6]}
        assert {tuple(r) for r in rec._visited(visits, items(count), hidden(count), 3, 6).collect()} == want
