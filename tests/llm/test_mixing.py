"""Hierarchical budgets against plain water-filling, prefixes, odd cases."""

from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from tastegrid.llm import mixing
from tests.llm.cases import documents, empty


def fill(budget, children):
    """children: name -> (weight, cap); exact shares with shortages passed on to siblings."""
    given, open_ = {}, dict(children)
    while open_:
        left = budget - sum(given.values())
        weight = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c * weight <= w * left}
        if not full:
            return given | {n: Fraction(w * left, weight) // 1 for n, (w, _) in open_.items()}
        least = min(full, key=lambda n: (Fraction(full[n], open_[n][0]), n))
        given[least] = full[least]
        del open_[least]
    return given


def test_budgets_follow_the_tree(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 9), ("web", "fr", "c", 1), ("forum", "en", "d", 500),
              ("archive", "de", "e", 3), ("archive", "en", "f", 0)]
    plan = mixing.Plan(budget_percent=50, max_epochs=2)
    df = spark.createDataFrame(leaves, "domain string, language string, source string, tokens bigint")
    got = {(r.domain, r.language, r.source): r.budget for r in mixing.budgets(df, plan).collect()}
    cap = lambda path: sum(2 * n for *p, n in leaves if tuple(p[:len(path)]) == path)
    weight = lambda level, name: plan.weights[level].get(name, 1)
    want = {(): min(sum(n for *_, n in leaves) // 2, cap(()))}
    for depth, level in enumerate(mixing.LEVELS):
        kids = defaultdict(dict)
        for *path, _ in leaves:
            kids[tuple(path[:depth])][path[depth]] = (weight(level, path[depth]), cap(tuple(path[:depth + 1])))
        want = {(*p, n): b for p, c in kids.items() for n, b in fill(want[p], c).items()}
    assert got == want


def test_prefix_of_seeded_epochs(spark):
    docs = [(i, "w " * (i % 7 + 1), "src0", "en") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    plan = mixing.Plan(budget_percent=70, max_epochs=3, seed=9)
    out, name = mixing.select(df, plan)
    got = {r.doc_id: r.copies for r in out.select("doc_id", F.col(name)["copies"].alias("copies")).collect()}
    size = {i: i % 7 + 1 for i, *_ in docs}
    budget, used, want = sum(size.values()) * 70 // 100, 0, set()
    order = df.select("doc_id", mixing.order_key(F.col("doc_id"), F.lit(0), 9).alias("k")).orderBy("k").collect()
    for r in order:
        used += size[r.doc_id]
        if used > budget:
            break
        want.add(r.doc_id)
    assert got == dict.fromkeys(want, 1)


def test_more_than_one_epoch(spark):
    docs = [(i, "a b c", "src0", "en") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    out = mixing.choose(df, mixing.Plan(budget_percent=150, max_epochs=4))
    counts = out.groupBy("doc_id").count().groupBy("count").count().orderBy("count").collect()
    assert [tuple(r) for r in counts] == [(1, 25), (2, 25)]


def test_odd_cases(spark):
    docs = documents(spark)
    every = mixing.choose(docs, mixing.Plan(budget_percent=100, max_epochs=1))
    assert every.columns == docs.columns and every.count() == docs.count()
    assert mixing.choose(empty(spark), mixing.Plan()).count() == 0
