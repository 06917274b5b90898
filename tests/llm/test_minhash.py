"""Near-duplicates against all pairs."""

import random

import numpy as np

from tastegrid.llm import minhash
from tastegrid.llm.graph import components
from tastegrid.llm.sketch import WordHashes, fast_sketches, shingle_set
from tests.llm.cases import documents, empty, rows


def brute(texts):
    """texts: (id, text); (id -> least id reachable) by word tuples."""
    sets = []
    for key, text in texts:
        w = (text or "").encode().lower().split()
        sets.append((key, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    root = {k: k for k, _ in sets if k is not None}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in root}, {k: len(s) for k, s in sets}


def test_groups_equal_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "w" + str(rng.randrange(5_000))
    texts = []
    for g in range(30):
        base = [word() for _ in range(rng.choice([3, 5, 6, 40, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0, 0.01, 0.02, 0.03, 0.05, 0.1]))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts = list(enumerate(rng.sample(texts, len(texts))))
    texts += [(9_000 + i, t.upper()) for i, t in texts[:5]]
    want, sizes = brute(texts)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for r in minhash.near_duplicates(df).collect():
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.id], sizes[r.id], want[r.id] == r.id)


def test_small_blocks_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"t{i}" for i in range(100)]
    texts = [(n, " ".join([*base[:n], f"x{n}", *base[n + 1:]])) for n in range(40)]
    texts += [(100 + n, " ".join([*base[:60], *[f"y{n}_{i}" for i in range(40)]])) for n in range(10)]
    want, _ = brute(texts)
    got = {r.id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == want


def test_odd_cases(spark):
    want, _ = brute([(r[0], r[1]) for r in rows()])
    out = minhash.near_duplicates(documents(spark)).collect()
    assert len(out) == len(rows())
    for r in out:
        assert r.component_id == want.get(r.id) and r.kept == (r.id is None or want[r.id] == r.id)
    one = minhash.keep_one(documents(spark))
    assert one.columns == documents(spark).columns
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_sketches_estimate_the_similarity():
    hashes = WordHashes()
    a = shingle_set(" ".join(f"a{i}" for i in range(1_000)), hashes)
    b = shingle_set(" ".join(f"a{i}" for i in range(200, 1_200)), hashes)
    tiny = shingle_set("one", hashes)
    s = fast_sketches(np.concatenate([a, b, tiny]), np.array([len(a), len(b), len(tiny)]), 2_000)
    both = np.intersect1d(a, b).size / np.union1d(a, b).size
    assert abs((s[0] == s[1]).mean() - both) < 0.05
    assert (s != np.uint64(2**64 - 1)).all()


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(1_000, 1_001), (1_001, 1_000), (7_000, 7_000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1_000: 1_000, 1_001: 1_000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
