"""Chat formatting and quality rules: plain Python versions, odd cases."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tastegrid.llm import chat, quality
from tests.llm.cases import documents, empty, rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def measured(text):
    words = [w for w in SPACE.split(text or "") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(hit))


def test_ledger_matches_plain_python(spark):
    texts = [r[1] for r in rows()] + ["a b c a b c a b c", "x y x y x y", "l1\nl1\n \nl2\nl1", "é ü #*| <a> " * 30, "  a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality.ledger(df).collect():
        assert tuple(r[1:6]) == measured(texts[r.doc_id]), texts[r.doc_id][:40]


def test_ledger_odd_cases(spark):
    kept = quality.keep(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [11, 6, 7, 7, 8, None]
    assert quality.keep(empty(spark)).count() == 0
    assert quality.ledger(empty(spark)).count() == 0


def test_policies_and_ablations(spark):
    bit = {r: 1 << i for i, r in enumerate(quality.RULES)}
    bits = [0, bit["symbols"], bit["symbols"] | bit["capitals"], bit["few_words"], bit["symbols"]]
    df = spark.createDataFrame([(b,) for b in bits], "failed_bits int")
    assert df.filter(quality.verdict(F.col("failed_bits"), "v1")).count() == 4
    assert df.filter(quality.verdict(F.col("failed_bits"), "v2")).count() == 1
    got = {r.rule: (r.n_failed, r.n_only, r.fails_with) for r in quality.ablations(df).collect()}
    assert got["symbols"] == (3, 2, bit["symbols"] | bit["capitals"])
    assert got["capitals"] == (1, 0, bit["symbols"] | bit["capitals"])
    assert got["word_length"] == (0, 0, 0)


TURNS = [
    (1, 0, "user", "hi <|end|>\n there"), (1, 1, "user", r"again <\|turn|> \ <\\|turn|>"), (1, 2, "assistant", "é</s>[INST]"),
    (1, 3, "assistant", r"<<SYS>> <</SYS>> <\s> [\\/INST]"), (2, None, None, None), (2, 5, "assistant", ""),
    (2, 5, "assistant", "tie"), (None, 1, "a%\nb%25<|x|>", "<"), (3, 0, "user", "<|"), (3, 1, "assistant", "|>"),
    (3, 1, "assistant", "|>"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, 9, 9) for t in TURNS],
                               "conv_id bigint, turn bigint, role string, text string, turns int, formatted int")
    done = chat.format_conversations(df).select(
        "*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    by_id = {}
    for c, turn, role, text in TURNS:
        by_id.setdefault(c, []).append((turn if turn is not None else -1, role or "", text or ""))
    out = {r.conv_id: r for r in done.collect()}
    assert set(out) == set(by_id)
    for c, r in out.items():
        want = [(role, text) for _, role, text in sorted(by_id[c])]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")
        assert r.n_messages == sum(i == 0 or want[i][0] != want[i - 1][0] for i in range(len(want)))
        for s in r.loss_spans:
            assert 0 <= s.start <= s.end <= len(r.formatted)


def test_chat_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_chat_query_has_the_planted_conversation(spark, folder):
    r = chat.query(spark, folder).filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
