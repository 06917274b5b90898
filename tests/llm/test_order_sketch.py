"""Order MinHash against a plain definition, the successor's edit against brute force, odd cases."""

import hashlib
import math
import random

import numpy as np

from tastegrid.llm import order_sketch
from tests.llm.cases import SCHEMA, documents, empty


def plain(text, sketcher):
    """Each coordinate by sorting all numbered k-mers."""
    if not text:
        return [0] * sketcher.coordinates
    hashes = order_sketch.kmers(text)
    seen, items = {}, []
    for h in hashes.tolist():
        seen[h] = seen.get(h, -1) + 1
        items.append(h + seen[h] * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    items = order_sketch._mix(np.array(items, np.uint64)).tolist()
    out = []
    for factor, shift in zip(sketcher.factor.ravel().tolist(), sketcher.shift.ravel().tolist()):
        places = sorted(range(len(items)), key=lambda i: (((items[i] >> 32) * factor + shift) & 0xFFFFFFFF, i))
        value = np.array([min(sketcher.picked, len(items))], np.uint64)
        for i in sorted(places[:sketcher.picked]):
            value = order_sketch._mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[i])
        out.append(int(value[0] % np.uint64(65_535)) + 1)
    return out


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        out[key] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), changed, following)
    return out


def check(rows, got):
    want, sketcher = brute(rows), order_sketch.Sketcher()
    assert len(got) == len(rows)
    for r in got:
        n, digest, changed, following = want[r["doc_id"]]
        own = sketcher.sketch(next(t for k, t in rows if k == r["doc_id"]))
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (n, digest, own.tobytes().hex())
        assert r["edited_fingerprint"] == sketcher.sketch(changed).tobytes().hex()
        assert r["near_edited"] == order_sketch.likeness(own, sketcher.sketch(changed))
        assert r["near_next"] == order_sketch.likeness(own, sketcher.sketch(following))


def test_sketch_equals_the_definition():
    rng, sketcher = random.Random(5), order_sketch.Sketcher(16, 3)
    for n in (1, 2, 3, 7, 8, 9, 40, 900, 5_000):
        for letters in ("a", "ab", "abcdeé漢😀 "):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert sketcher.sketch(text).tolist() == plain(text, sketcher), (n, letters)
    assert not sketcher.sketch("").any()


def test_likeness_falls_with_edits_and_with_moved_passages():
    rng, sketcher = random.Random(6), order_sketch.Sketcher(128)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(250)) for _ in range(4)]
    text, of = "".join(parts), lambda t: order_sketch.likeness(sketcher.sketch(text), sketcher.sketch(t))
    one, many = text[:500] + "XY" + text[502:], "".join(c if i % 20 else "#" for i, c in enumerate(text))
    moved = parts[2] + parts[3] + parts[0] + parts[1]
    assert of(text) == 1 and of(one) > 0.9 > of(many) and of(moved) < 0.75 and of(text[::-1]) < 0.05


def test_likeness_of_the_production_sketch_spreads_as_independent_draws_do():
    """200 texts with two changed code points, and with a new half: mean as the shared k-mers say, spread as of 96 coin tosses."""
    rng, sketcher = random.Random(1), order_sketch.Sketcher()
    small, large = [], []
    for _ in range(200):
        text = "".join(rng.choice("abcdefgh ") for _ in range(1_000))
        own, other = sketcher.sketch(text), "".join(rng.choice("abcdefgh ") for _ in range(500))
        small.append(order_sketch.likeness(own, sketcher.sketch(text[:500] + "XY" + text[502:])))
        large.append(order_sketch.likeness(own, sketcher.sketch(text[:500] + other)))
    for values, low, high in ((small, 0.955, 0.972), (large, 0.095, 0.120)):  # (991/1009)^2 and about (1/3)^2
        mean = sum(values) / len(values)
        assert low < mean < high and np.std(values) < 1.15 * math.sqrt(mean * (1 - mean) / order_sketch.COORDINATES)


def test_rows_over_many_ranges(spark):
    rng = random.Random(7)
    rows = [(i * 7 % 1_009, "".join(rng.choice("abc dé\n") for _ in range(rng.choice((0, 1, 5, 60, 300))))) for i in range(200)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(rows, order_sketch.with_next(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_documents_of_the_tables(spark, folder):
    rows = [(r[0], r[1] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = order_sketch.query(spark, folder).collect()
    check(rows, got)
    long = [r for r in got if r["n_chars"] > 100]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)


def test_odd_cases(spark):
    got = order_sketch.with_next(documents(spark)).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 13 and len(of[7]) == 2 and {r["fingerprint"] for r in of[7]} == {of[6][0]["fingerprint"]}
    assert max(r["near_next"] for r in of[7]) == 1.0 and of[1][0]["fingerprint"] == of[2][0]["fingerprint"] == "0" * 4 * order_sketch.COORDINATES
    assert of[2][0]["near_next"] == 1.0 and of[2][0]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert order_sketch.with_next(empty(spark)).collect() == [] and order_sketch.fingerprints(empty(spark)).collect() == []
    single = order_sketch.with_next(spark.createDataFrame([(5, "only one", *[None] * 12)], SCHEMA)).first()
    assert single["near_next"] == 1.0 and single["edited_sha256"] == hashlib.sha256(b"onlyonly").hexdigest()
    plain_ = {r["doc_id"]: r["fingerprint"] for r in order_sketch.fingerprints(documents(spark)).collect()}
    assert plain_[6] == of[6][0]["fingerprint"]
