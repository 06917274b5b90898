"""Hidden Markov model and language identification: brute force, held-out accuracy, odd cases."""

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tastegrid.llm import hmm, langid
from tests.llm.cases import documents, empty


def small_model():
    rng = np.random.default_rng(0)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))).T, norm(rng.random(3)))


def likelihood(m, s):
    return sum(m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(m.move[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], s[1:]))
               for p in product(range(3), repeat=len(s)))


def test_forward_sums_over_all_paths():
    m = small_model()
    sequences = [np.array(s, np.int32) for s in ([0], [1, 2, 3], [4, 4, 0, 1, 2], [3, 1], [2, 0, 0, 4])]
    for s, got in zip(sequences, m.forward(sequences)):
        assert math.isclose(got, math.log(likelihood(m, s)), rel_tol=1e-9)


def test_expected_counts_sum_over_all_paths():
    m = small_model()
    s = [1, 0, 4, 2]
    windows = np.array([[1, 0, 4, 2], [3, -1, -1, -1]], np.int32).T
    start, move, emit = m.expected(windows, np.array([True, True]))
    total = likelihood(m, s)
    want = np.zeros((3, 3))
    for p in product(range(3), repeat=4):
        weight = m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(m.move[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], s[1:]))
        for a, b in zip(p, p[1:]):
            want[a, b] += weight / total
    assert np.allclose(move, want)
    assert math.isclose(start.sum(), 2) and math.isclose(emit.sum(), 5) and math.isclose(emit[3].sum(), 1)


def test_scores(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in docs.items() if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    rows = hmm.query(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = words(docs[r.doc_id])
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, held(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


class Held:
    def __init__(self, value):
        self.value = value


def test_start_counts_every_training_text():
    texts = [None, "", *("ab ba abba " * (n % 3 + 1) for n in range(9)), *("xyz zy\u00e9 " * (n % 4 + 1) for n in range(9))]
    batches = lambda: iter(pa.RecordBatch.from_arrays([pa.array(texts[at:at + 7], pa.string())], names=["text"]) for at in range(0, 20, 7))
    counted = {}
    for batch in hmm.count_words(batches()):
        for w, n in zip(*(c.to_pylist() for c in batch.columns)):
            counted[w] = counted.get(w, 0) + n
    letters = hmm.letters_of(texts)
    assert counted[hmm.moment(0, 0)] == len(texts) and counted[b"ab"] == 18
    assert all(counted.get(hmm.moment(i + 1, j + 1), 0) == letters[:, i] @ letters[:, j] for i in range(64) for j in range(64))
    axes = hmm.axes_of(counted)
    symbols = hmm.Symbols([b"ab", b"ba", b"abba", b"xyz"])
    grouped = np.zeros((symbols.size, hmm.STATES))
    for batch in hmm._grouped(Held(symbols), Held(axes))(batches()):
        columns = [np.array(c) for c in batch.columns]
        grouped[columns[0]] += np.stack(columns[1:], axis=1)
    assert grouped.sum() == sum(len(hmm.words_of(t)) + 1 for t in texts) and grouped[symbols.end].sum() == len(texts)
    assert not (grouped[0] * grouped[3]).any() and grouped[0].sum() == 18 and grouped[3].sum() == counted[b"xyz"]


def test_hmm_odd_cases(spark):
    docs = documents(spark)
    out = hmm.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0).collect()
    assert len(out) == docs.count() and all(math.isfinite(r.score) for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    alone = hmm.score(docs, F.lit(False)).collect()
    assert {r.n_known for r in alone} == {0} and {r.train_tokens for r in alone} == {0}
    assert hmm.score(empty(spark), F.lit(True)).count() == 0


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = [r for r in langid.query(spark, folder).collect() if r.held_out]
    assert len(out) > 200
    assert sum(true[r.doc_id] == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_language_odd_cases(spark):
    docs = documents(spark).withColumn("text", F.when(F.col("doc_id") == 4, "12 34 !").otherwise(F.col("text")))
    out = langid.predict(docs, langid.train(docs, F.lit(True))).collect()
    assert len(out) == docs.count()
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (1, 2, 3, 4)} == {("und", 0.0)}
    assert langid.train(docs, F.lit(False)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(empty(spark), None).count() == 0


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4_000, 4)) * 2
    labels = np.array([rng.choice(4, p=p) for p in langid.softmax(logits)])
    assert abs(langid.temperature(logits * 5, labels) - 5) < 0.7


def test_words_are_looked_up_once():
    symbols = hmm.Symbols([b"ab", b"ba"])
    texts = [None, "ab rare ba rare other ab", "Ab é"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([True, None, False]), pa.array(texts, pa.string())],
                                       names=["key", "train", "text"])
    rows = next(hmm._numbered(Held(symbols))(iter([batch]))).to_pylist()
    assert [(r["key"], r["train"]) for r in rows] == [(1, True), (2, None), (3, False)]
    for r, text in zip(rows, texts):
        words = hmm.words_of(text)
        expected = [symbols.of.get(w, 2 + zlib.crc32(w[-3:]) % hmm.TAILS) for w in words] + [symbols.end]
        assert np.frombuffer(r["symbols"], hmm.STORED).tolist() == expected
        assert {t["word"]: t["n"] for t in r["tail"]} == Counter(w for w in words if w not in symbols.of)
    # later steps take the numbers, not the texts
    model = hmm.Model(np.full(2, 0.5), np.full((2, 2), 0.5), np.full((symbols.size, 2), 1 / symbols.size), np.full(2, 0.5))
    numbers = pa.RecordBatch.from_arrays([pa.array([r["symbols"] for r in rows], pa.binary())], names=["symbols"])
    counted = next(hmm._expect(Held(model))(iter([numbers]))).to_pylist()
    assert math.isclose(sum(r["s0"] + r["s1"] for r in counted if r["symbol"] >= 0), sum(len(hmm.words_of(t)) + 1 for t in texts))
