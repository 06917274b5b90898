"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from tastegrid.llm import neighbours


def brute(vectors):
    ids = [k for k, v in vectors if k is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    x = {k: np.array(v, np.float64) for k, v in vectors if k in ids}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = {k: {j for j in ids if j != k and cos(x[k], x[j]) >= 0.9} for k in ids}
    return links


def test_small_table_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    x = (base[rng.integers(0, 12, 150)] + 0.12 * rng.normal(size=(150, 8))).astype(np.float32)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vectors += [(200, vectors[3][1]), (201, vectors[3][1]), (202, [2 * c for c in vectors[3][1]])]
    odd = [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] + [0.0] * 6), (304, [float("nan")] + [1.0] * 7),
           (305, [float("inf")] + [1.0] * 7), (306, [1.0, 2.0]), (None, vectors[3][1])]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in vectors + odd],
                               "vec_id bigint, embedding array<float>, id int, class int")
    links = brute(vectors)
    out = {r.id: r for r in neighbours.near_duplicates(df).collect()}
    assert len(out) == len(vectors) + len(odd)
    assert sum(r.n_links for r in out.values()) == pytest.approx(sum(map(len, links.values())), rel=0.02)
    for k, r in out.items():
        if k in links:
            assert r.n_links <= len(links[k])
        else:
            assert r.n_links == 0 and r.component_id == k and r.kept


def test_recall_on_the_tables(spark):
    """n_links against brute force over the whole table: at least 0.99 of all links, and none too many."""
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in neighbours.query(spark, folder).collect()}
    found = np.array([got[r.vec_id] for r in rows])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum()


@pytest.mark.parametrize("size", [4, 16, 64])
def test_planted_pairs_over_many_cells(spark, monkeypatch, size):
    monkeypatch.setattr(neighbours, "CELL", 16)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "TILE", 16)
    rng = np.random.default_rng(size)
    base = neighbours.unit(rng.normal(size=(700, size)))
    aside = rng.normal(size=base.shape)
    aside = neighbours.unit(aside - (aside * base).sum(axis=1, keepdims=True) * base)
    cos = rng.uniform(0.9001, 0.95, size=(700, 1))
    x = np.r_[base, cos * base + np.sqrt(1 - cos ** 2) * aside].astype(np.float32)
    exact = neighbours.unit(x)
    links = exact @ exact.T >= 0.9
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    out = {r.id: r for r in neighbours.near_duplicates(df).collect()}
    true = links.sum(axis=1) - 1
    assert true.sum() >= 1_400 and [out[i].n_links for i in range(len(x))] == true.tolist()
    assert all(out[int(a)].component_id == out[int(b)].component_id for a, b in np.argwhere(links))


@pytest.mark.parametrize("cell,block", [(8_192, 16_384), (4, 3)])
def test_lengths_apart_and_double_precision(spark, monkeypatch, cell, block):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(12, 4)))]
    rows += [(20, [1e39] * 4), (21, [2e39] * 4), (22, [1e-60, 0.0, 0.0, 0.0]), (23, [3e-60, 0.0, 0.0, 0.0]), (24, [1e-320, 0.0, 0.0, 0.0]),
             (30, [1.0, 2.0]), (31, [2.0, 4.0]), (32, [-1.0, 2.0]), (33, [1.0, 2.0, 0.0]), (40, [5.0]), (41, [-5.0]), (42, [7.0])]
    out = {r.id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    for k, v in rows:
        near = []
        for j, w in rows:
            if j != k and len(v) == len(w):
                a, b = (np.array(z) / np.abs(z).max() for z in (v, w))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    near.append(j)
        assert out[k].n_links == len(near) and out[k].component_id == min([k, *near]), k
    assert out[21].component_id == 20 and out[24].n_links >= 2 and out[31].n_links == 1 and out[42].component_id == 40


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.near_duplicates(df).count() == 0
