"""Spelling variants against brute force, at several part sizes, and odd cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from tastegrid.llm import variants
from tests.llm.cases import documents, empty


def vocabulary(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(counts):
    slots = {}  # words that are equal without one letter, or of which one is the other without a letter
    for w in counts:
        for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            slots.setdefault(k, []).append(w)
    links = {w: set() for w in counts}
    for held in slots.values():
        for i, a in enumerate(held):
            for b in held[i + 1:]:
                if near(a, b):
                    links[a].add(b)
                    links[b].add(a)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(links[w]), counts[form[w]] if form[w] else None)
    return out


def answers(df):
    got = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


def made(rng, size):
    stems = ["".join(rng.choice("abé") for _ in range(rng.choice((7, 7, 8, 9)))) for _ in range(size)]
    out = {}
    for w in stems:
        out[w] = rng.choice((2, 3, 30, 300, 3_000))
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w) + 1)
            v = rng.choice((w[:i] + rng.choice("abéÿ") + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice("abcÿ") + w[i + 1:]))
            if len(v) >= 7:
                out[v] = rng.choice((2, 20, 200))
    return out


def test_composition_equals_all_pairs():
    rng = random.Random(1)
    for _ in range(60):
        held = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))})
        got = list(variants.composed(held))
        want = {frozenset((a, b)) for i, a in enumerate(held) for b in held[i + 1:] if near(a, b)}
        assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_acceptor_is_minimal():
    root = variants.minimal(sorted({s + e for s in ("ab", "cd", "xy") for e in ("ing", "ed", "s")}))
    seen, todo = set(), [root]
    while todo:
        state = todo.pop()
        if id(state) not in seen:
            seen.add(id(state))
            todo += state.arcs.values()
    assert len(seen) == 9 and root.least == 3  # start, one state behind all first letters, behind them; i, in, e, and the end


@pytest.mark.parametrize("part", [4_000, 40, 1])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(variants, "GROUP", part)
    counts = made(random.Random(part), 150)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert answers(variants.group(df)) == brute(counts)


def test_documents_of_the_tables(spark, folder, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(vocabulary(rows))
    assert len(want) > 1_000 and answers(variants.query(spark, folder)) == want
    monkeypatch.setattr(variants, "GROUP", 50)
    assert answers(variants.query(spark, folder)) == want


def test_long_words_and_long_shared_starts(spark, monkeypatch):
    monkeypatch.setattr(variants, "GROUP", 2)
    long = "".join(random.Random(3).choice("abcdefg") for _ in range(30_000))
    counts = {long: 500, long[:9_000] + "z" + long[9_000:]: 2, long[1:]: 3, "q" * 2_000: 4, "q" * 2_001: 50, "q" * 1_999: 2,
              **{"prefix" * 20 + w: n for w, n in (("a", 2), ("b", 30), ("ab", 400), ("", 5))}}
    assert answers(variants.group(spark.createDataFrame(list(counts.items()), "word string, n bigint"))) == brute(counts)


def test_odd_cases(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows += [(None, "Überall ÜBERALL überall Straßen STRAßEN strassen×strassen"), (77, None), (78, "x" * 100_000), (79, "x" * 100_000)]
    df = spark.createDataFrame([(t, k, 1, 2) for k, t in rows], "text string, doc_id bigint, word int, n int")
    got = answers(variants.group(variants.words(df)))
    assert got == brute(vocabulary(rows)) and "Überall" not in got or got["Überall"][2] >= 2
    assert variants.group(variants.words(empty(spark))).collect() == []
