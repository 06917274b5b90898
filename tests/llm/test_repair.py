"""Conversation repair against a plain programme over single rows, and against all edit sequences of short ones."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from tastegrid.llm import repair

sys.setrecursionlimit(20_000)
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h <= 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        here += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def fault(rows, i):
    _, role, text = rows[i]
    solid = text.strip(SPACE)
    if not solid:
        return "blank"
    if any(r[1:] == (role, text) for r in rows[:i]):
        return "duplicate"
    return "" if solid[-1] in ".!?" else "truncated"


def best(rows, faults):
    """(cost, audit, lines) by a recursion over rows and what was written last."""
    @lru_cache(None)
    def go(i, last, inserted):
        found = []
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for r in follows.replace("s", ""):
                cost, audit, lines = go(i, r, inserted + 1)
                found.append((cost + 2, "I" + audit, ({"u": "user:", "a": "assistant:"}[r], *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = go(i + 1, last, 0)
            found.append((cost + 3, "D" + audit, lines))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                for r in follows:
                    cost, audit, lines = go(i + 1, r, 0)
                    if role[:1] == r:
                        found.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                    if r != "s":
                        found.append((cost + 2 + more, "R" + audit, ({"u": "user:", "a": "assistant:"}[r] + text, *lines)))
        return min(found) if found else (10 ** 9, "", ())
    return go(0, "", 0)


def brute(rows):
    out = {}
    for conv, here in damaged(rows).items():
        here = sorted(here, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = [fault(here, i) for i in range(len(here))]
        turns = {t for t, _, _ in here if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(here, here[1:]))
        cost, audit, lines = best(tuple(here), tuple(faults))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def answers(df):
    got = repair.repair(repair.damage(df)).collect()
    out = {r[0]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def made(rng, convs, rows):
    out = []
    for conv in range(convs):
        for turn in range(rng.choice(rows)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            text = rng.choice(("Yes.", "No?", "cut", " \n", "", None, f"text {rng.randint(0, 9)}", "dots... ", "ok!\t"))
            out.append((conv, rng.choice((turn, turn * 2, turn, None)) if rng.random() < 0.2 else turn, role, text))
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_all_edit_sequences_of_short_conversations():
    runs, signs = repair.Runs(), "suaoSUAOx"
    pattern = re.compile("(s?(ua)+)?")

    def sequences(here, budget):
        """(cost, audit, initials) of every edit sequence up to a cost."""
        if not here:
            yield 0, "", ""
        else:
            for cost, audit, roles in sequences(here[1:], budget - 3) if budget >= 3 else ():
                yield cost + 3, "D" + audit, roles
            sign = here[0]
            if sign != "x":
                more = int(sign.isupper())
                for letter, role, price in (("K", sign.lower(), more), ("R", "u", 2 + more), ("R", "a", 2 + more)):
                    if budget >= price:
                        for cost, audit, roles in sequences(here[1:], budget - price):
                            yield cost + price, letter + audit, role + roles
        if budget >= 2:
            for cost, audit, roles in sequences(here, budget - 2):
                for role in "ua":
                    yield cost + 2, "I" + audit, role + roles

    for n in range(3):
        for here in itertools.product(signs, repeat=n):
            want = min((c, a) for c, a, roles in sequences(here, 3 * n) if pattern.fullmatch(roles))
            audit, state = "", 0
            for letters, state in runs.unroll("".join(here), 0, repair.END):
                audit += letters
            talk = repair.Conversation(runs)
            talk.state = state
            tail = talk.result()[6]
            assert (repair.apply(runs.matrix("".join(here)), repair.END)[0], audit + tail) == want, here


def test_runs_equal_single_steps():
    runs, rng = repair.Runs(), random.Random(2)
    for _ in range(40):
        signs = "".join(rng.choice("suaoSUAOx") * rng.choice((1, 2, 7, 200)) for _ in range(6))
        after = repair.END
        for sign in reversed(signs):
            after = repair.apply(runs.power(sign, 0), after)
        assert repair.apply(runs.matrix(signs), repair.END) == after
        assert len(list(runs.unroll(signs, 0, repair.END))) == len(signs)


@pytest.mark.parametrize("piece", [128, 3, 1])
def test_against_the_plain_programme(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rows = made(random.Random(piece), 90, (0, 1, 2, 3, 5, 9, 14))
    assert answers(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_one_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, t, r, x) for _, t, r, x in made(random.Random(9), 1, (300,))] + made(random.Random(8), 4, (6,))
        rows = [(c if i < 300 else c + 2, t, r, x) for i, (c, t, r, x) in enumerate(rows)]
        assert answers(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_conversations_of_the_tables(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repair.query(spark, folder)
    assert got.columns[0] == "conv_id" and {r[0]: tuple(r)[1:] for r in got.collect()} == brute(rows)


def test_odd_cases(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", None), (5, None, None, None), (6, 3, "user", "x" * 300_000 + "."),
            (6, 3, "user", "x" * 300_000 + "."), (7, -(1 << 63), "user", "a."), (7, (1 << 63) - 1, "assistant", "b.")]
    dropped = next(c for c in range(100, 1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    schema = SCHEMA + ", part int, no int, `first.has` int, audit int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)
    got, want = answers(df), brute(rows)
    want[7] = ((1 << 63) - 1 if want[7][0] >= 1 << 63 else want[7][0], *want[7][1:])
    assert got == want and got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert answers(spark.createDataFrame([], schema)) == {}
