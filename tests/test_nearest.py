"""Nearest rows against all pairs: many small blocks, hot columns, ties, asked rows only."""

import math
import random

import pytest

from tastegrid.operators import nearest as near
from tastegrid.operators import similarity


def brute(rows, k, asked):
    vectors = {}
    for e, i, c in rows:
        vectors.setdefault(e, {})[i] = c
    out = set()
    for e in asked:
        if e in vectors:
            found = []
            for f in vectors:
                dot = sum(c * vectors[f].get(i, 0) for i, c in vectors[e].items())
                if f != e and dot:
                    sim = dot / (math.sqrt(sum(c * c for c in vectors[e].values())) * math.sqrt(sum(c * c for c in vectors[f].values())))
                    found.append((-round(sim, 9), f))
            out |= {(e, f, r + 1, -s) for r, (s, f) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("block,part,cells", [(1 << 16, 1 << 18, 1 << 22), (64, 40, 50), (16, 16, 1)])
def test_nearest_equals_all_pairs(spark, monkeypatch, block, part, cells):
    rng = random.Random(block)
    rows = {}
    for n in range(70):
        for _ in range(rng.randint(1, 9)):
            rows[f"u{n:02}", rng.choice(("hot", *(f"i{m % 25}" for m in range(n % 5, 30, 3))))] = rng.choice((1, 1, 2, 7))
    rows[("lonely", "own")] = 3
    rows = [(*key, c) for key, c in rows.items()]
    monkeypatch.setattr(near, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(near, "PART_ENTRIES", part)
    monkeypatch.setattr(near, "CELLS", cells)
    matrix = spark.createDataFrame(rows, "user_id string, item_id string, c bigint")
    asked = [f"u{n:02}" for n in range(0, 70, 2)] + ["lonely", "nobody"]
    got = near.nearest(matrix, "user_id", "item_id", spark.createDataFrame([(a,) for a in asked], "user_id string"), 6).collect()
    assert {(r.user_id, r.neighbor, r["rank"], round(r.sim, 9)) for r in got} == brute(rows, 6, asked)


@pytest.mark.parametrize("columns,tile", [(4096, (512, 4096)), (4096, (7, 5)), (0, (512, 4096))])
def test_rows_of_one_direction_are_one_class(spark, monkeypatch, columns, tile):
    rng = random.Random(11)
    rows = {}
    for n in range(24):
        items = {rng.choice([f"i{m}" for m in range(9)]): rng.choice((1, 1, 2)) for _ in range(rng.randint(1, 5))}
        for copy in range((1, 3, 12)[n % 3]):  # some classes have more members than neighbours are asked for
            user = f"u{rng.randrange(10 ** 6):06}"
            rows |= {(user, i): c * (1, 3)[copy % 2] for i, c in items.items()}
    monkeypatch.setattr(near, "DENSE_COLUMNS", columns)
    monkeypatch.setattr(near, "DENSE_ROWS", 8)
    monkeypatch.setattr(near, "TILE", tile)
    rows = [(*key, c) for key, c in rows.items()]
    everyone = sorted({e for e, _, _ in rows})
    matrix = spark.createDataFrame(rows, "user_id string, item_id string, c bigint")
    got = near.nearest(matrix, "user_id", "item_id", None, 6).collect()
    assert {(r.user_id, r.neighbor, r["rank"], round(r.sim, 9)) for r in got} == brute(rows, 6, everyone)
    some = everyone[::3]
    got = near.nearest(matrix, "user_id", "item_id", spark.createDataFrame([(a,) for a in some], "user_id string"), 6).collect()
    assert {(r.user_id, r.neighbor, r["rank"], round(r.sim, 9)) for r in got} == brute(rows, 6, some)


def test_members_of_a_large_class_are_not_compared(spark, monkeypatch):
    searched = []
    whole = near._search
    monkeypatch.setattr(near, "_search", lambda rep, asked, *x: searched.append(asked.count()) or whole(rep, asked, *x))
    rows = [(f"u{n:02}", f"i{m}", 1 + m) for n in range(9) for m in range(3)] + [("v", "i0", 1), ("w", None, 2), ("w", "i1", 1)]
    got = near.nearest(spark.createDataFrame(rows, "user_id string, item_id string, c bigint"), "user_id", "item_id", None, 5).collect()
    assert searched == [2] and len(got) == 11 * 5
    assert {round(r.sim, 9) for r in got if r.user_id == "w"} == {round(2 / math.sqrt(5 * 14), 9)}  # a null item adds to the length


def test_all_rows_and_no_rows(spark):
    inter = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "z")], "user_id string, item_id string")
    matrix = similarity.count_matrix(inter)
    got = {(r.user_id, r.neighbor) for r in near.nearest(matrix, "user_id", "item_id").collect()}
    assert got == {("a", "b"), ("b", "a")}
    assert near.nearest(matrix.limit(0), "user_id", "item_id").collect() == []


def test_similarity_of_asked_items_only(spark):
    inter = spark.createDataFrame([(f"u{n % 7}", f"i{n * n % 11}") for n in range(60)], "user_id string, item_id string")
    whole = {(r.a, r.b): r.sim for r in similarity.item_similarity(inter).collect()}
    rows, columns = inter.filter("item_id < 'i3'"), inter.filter("item_id > 'i2'")
    some = {(r.a, r.b): r.sim for r in similarity.item_similarity(inter, rows, columns).collect()}
    assert some == {(a, b): s for (a, b), s in whole.items() if a < "i3" and b > "i2"} and 0 < len(some) < len(whole)


@pytest.mark.parametrize("budget,route", [(1 << 20, "_carried"), (0, "_cells"), (0, "sparse_product")])
def test_routes_of_all_pairs(spark, monkeypatch, budget, route):
    rng = random.Random(5)
    wide = 12 if route == "_cells" else 400
    rows = {(f"u{rng.randrange(60):02}", f"i{int(wide * rng.random()):03}"): rng.choice((1, 1, 2, 5)) for _ in range(700)}
    taken = []
    for name in ("_carried", "_cells", "sparse_product"):
        whole = getattr(similarity, name)
        monkeypatch.setattr(similarity, name, lambda *x, whole=whole, name=name: taken.append(name) or whole(*x))
    monkeypatch.setattr(similarity, "PAIR_BUDGET", budget)
    monkeypatch.setattr(similarity, "CELL_ROWS", 16)
    monkeypatch.setattr(similarity, "CELL_COLUMNS", 5)
    monkeypatch.setattr(similarity, "CELL_LEAST", 0)
    if route == "sparse_product":
        rows = {**{k: c for k, c in rows.items() if k[0] < "u08"}, **{(f"v{n}", f"j{n}"): 1 for n in range(60)}}
    inter = spark.createDataFrame([k for k, c in rows.items() for _ in range(c)], "user_id string, item_id string")
    got = {(r.a, r.b): round(r.sim, 9) for r in similarity.user_similarity(inter).collect()}
    own = [(u, u, 0, 1.0) for u in {u for u, _ in rows}]
    every = brute([(*k, c) for k, c in rows.items()], 10 ** 6, {u for u, _ in rows})
    assert got == {(a, b): s for a, b, _, s in [*every, *own]} and taken == [route]


@pytest.mark.parametrize("name,plain", [("{}", True), ("{:03}", False), ("i{}", False), ("{}000000000", False)])
def test_what_item_similarity_carries_is_narrow(spark, name, plain):
    """Decimal ids go as integers and come back as the same text; all others, large counts too, go as they are."""
    rng = random.Random(5)
    rows = {(f"u{n % 60}", name.format(rng.randrange(90))): rng.choice((1, 2, 300)) for n in range(500)}
    vectors = {}
    for (u, i), c in rows.items():
        vectors.setdefault(i, {})[u] = c
    size = {i: math.sqrt(sum(c * c for c in v.values())) for i, v in vectors.items()}
    want = {}
    for a, x in vectors.items():
        for b, y in vectors.items():
            if dot := sum(c * y.get(u, 0) for u, c in x.items()):
                want[a, b] = round(dot / (size[a] * size[b]), 9)
    matrix = spark.createDataFrame([(*k, c) for k, c in rows.items()], "user_id string, item_id string, c bigint")
    got = similarity._carried(matrix, "item_id", "user_id", 5_000.0)
    assert {(r.a, r.b): round(r.sim, 9) for r in got.collect()} == want and got.dtypes[:2] == [("a", "string"), ("b", "string")]
    assert ("try_cast" in got._jdf.queryExecution().optimizedPlan().toString()) == plain


def test_blocks_are_not_shuffled_for_their_cells(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_ROWS", 4)
    monkeypatch.setattr(similarity, "CELL_OUT", 3)
    rows = [(f"u{n:02}", f"i{m}", 1 + (n * m) % 3) for n in range(30) for m in range(n % 4, 8)]
    got = similarity._cells(spark.createDataFrame(rows, "user_id string, item_id string, c bigint"), "user_id", "item_id", 30)
    users = {u for u, _, _ in rows}
    own = [(u, u, 0, 1.0) for u in users]
    assert {(r.a, r.b): round(r.sim, 9) for r in got.collect()} == {(a, b): s for a, b, _, s in [*brute(rows, 10 ** 6, users), *own]}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
