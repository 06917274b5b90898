"""Spelling variant grouping by finite-state composition.

The vocabulary (words of ``LEAST`` letters or more, seen twice or more) is split by the state that its acceptor reaches after
the first letters, once for the words and once for the words read backwards. Each part is built as a minimised acyclic
acceptor A, composed as A o T o A with the transducer T of exactly one inserted, deleted or replaced letter, and its accepted
pairs are enumerated: up to the edit both tapes run through the same state of A, behind it they run through the letters that
two states have in common. An edit behind the third letter leaves the first three equal; any other edit of a word of seven
letters leaves the last three equal. So the parts of both directions hold all pairs, and the backward ones report only pairs
whose first three letters differ: every pair comes up once, at the first letter that differs.

A part of more than ``GROUP`` words goes one branching further: pairs that differ at the branching letter itself are met by
grouping words without that letter (an alphabet's worth of words at most), all others share the next state. The parts only
return each word's number of near words and its best one, no pairs. Roots follow by pointer doubling: a form is ten times
as frequent as its word, so chains are short.

Defined cases: a null text has no words; a null id is written as the empty text; equal counts go to the smaller word in
code-point order; repeated rows count each; words of any length are compared whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import column, store

LEAST, SEEN, RATIO = 7, 2, 10
SHARED = 3       # letters that one of the two ends of a near pair has in common: LEAST >= 2 * SHARED + 1
GROUP = 4_000    # words of a part
SMALL = 100_000  # rows of a table that is broadcast
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the vocabulary, after the deletions that the rows' keys choose."""
    runs = F.regexp_extract_all(column(text).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST},}}"), F.lit(0))
    found = df.select(F.coalesce(column(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    found = found.select("key", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat_ws(":", "key", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substring(F.col("run"), at + 2, F.length("run")))
    found = found.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return (found.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= SEEN))


class State:
    """A state of the acceptor: whether it accepts, its arcs by letter, and the least number of letters to acceptance."""

    __slots__ = ("final", "arcs", "least")

    def __init__(self):
        self.final, self.arcs, self.least = False, {}, 0


def minimal(sorted_words: list[str]) -> State:
    """The minimised acyclic acceptor of sorted, distinct words, built word by word."""
    root, known = State(), {}
    path: list[tuple[State, str, State]] = []

    def close(down_to: int) -> None:
        while len(path) > down_to:
            parent, letter, state = path.pop()
            state.least = 0 if state.final else 1 + min(s.least for s in state.arcs.values())
            same = known.setdefault((state.final, *((c, id(s)) for c, s in state.arcs.items())), state)
            parent.arcs[letter] = same

    before = ""
    for word in sorted_words:
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        close(shared)
        state = path[-1][2] if path else root
        for letter in word[shared:]:
            child = State()
            state.arcs[letter] = child
            path.append((state, letter, child))
            state = child
        state.final, before = True, word
    close(0)
    root.least = 0 if root.final or not root.arcs else 1 + min(s.least for s in root.arcs.values())
    return root


def common(p: State, q: State, limit: int | None, barred: str = "") -> Iterator[str]:
    """Letters that lead from both states to acceptance, up to ``limit`` of them, not beginning with ``barred``."""
    if p.final and q.final:
        yield ""
    if limit == 0:
        return
    both = lambda a, b: iter([(c, s, b.arcs[c]) for c, s in a.arcs.items() if c in b.arcs])
    stack, letters = [iter([x for x in both(p, q) if x[0] != barred])], []
    while stack:
        arc = next(stack[-1], None)
        if arc is None:
            stack.pop()
            if letters:
                letters.pop()
            continue
        letters.append(arc[0])
        if arc[1].final and arc[2].final:
            yield "".join(letters)
        if limit is None or len(letters) < limit:
            stack.append(both(arc[1], arc[2]))
        else:
            letters.pop()


def edits(state: State, limit: int | None) -> list[tuple[str, str]]:
    """Pairs accepted from a state when the edit comes first: a replaced letter, or one that only the first word has."""
    if limit is not None and state.least > limit + 1:
        return []
    arcs, out = list(state.arcs.items()), []
    for i, (a, p) in enumerate(arcs):
        for b, q in arcs[i + 1:]:
            out += [(a + s, b + s) for s in common(p, q, limit)]
        out += [(a + s, s) for s in common(p, state, limit, a)]
    return out


def composed(sorted_words: list[str], limit: int | None = None) -> Iterator[tuple[str, str]]:
    """All pairs of words with exactly one edit, each once; with a limit only those with so few letters behind the edit."""
    root = minimal(sorted_words)
    memo: dict[int, list[tuple[str, str]]] = {}
    letters, stack = [], [("", root, None)]
    while stack:
        _, state, arcs = stack[-1]
        if arcs is None:
            if id(state) not in memo:
                memo[id(state)] = edits(state, limit)
            if memo[id(state)]:
                prefix = "".join(letters)
                for a, b in memo[id(state)]:
                    yield prefix + a, prefix + b
            arcs = iter(state.arcs.items())
            stack[-1] = ("", state, arcs)
        arc = next(arcs, None)
        if arc is None:
            stack.pop()
            if letters:
                letters.pop()
        else:
            letters.append(arc[0])
            stack.append((*arc, None))


PART = "word string, n_near bigint, best struct<rank:bigint,word:string>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each word inside its part; the parts arrive one after another."""
    kind = pa.struct([("rank", pa.int64()), ("word", pa.string())])

    def finished(backward: bool, depth: int, held: dict[str, int]) -> pa.RecordBatch:
        near, best = {}, {}
        for x, y in composed(sorted(w[depth:] for w in held), SHARED - 1 if backward else None):
            if backward:
                x, y = head + x, head + y
                if x[-SHARED:] == y[-SHARED:]:
                    continue
                one, two = (-held[x], x[::-1]), (-held[y], y[::-1])
            else:
                x, y = head + x, head + y
                one, two = (-held[x], x), (-held[y], y)
            for word, other in ((one[1], two), (two[1], one)):
                near[word] = near.get(word, 0) + 1
                best[word] = min(best.get(word, other), other)
        return pa.RecordBatch.from_arrays(
            [pa.array(near, pa.string()), pa.array(near.values(), pa.int64()),
             pa.array([{"rank": best[w][0], "word": best[w][1]} for w in near], kind)], names=["word", "n_near", "best"])

    current, held, head = None, {}, ""
    for batch in batches:
        for backward, prefix, spelled, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (backward, prefix) != current:
                if held:
                    yield finished(current[0], len(head), held)
                current, held, head = (backward, prefix), {}, prefix
            held[spelled] = n
    if held:
        yield finished(current[0], len(head), held)


def _at_branching(crowd: DataFrame) -> DataFrame:
    """Near pairs of words whose first difference is at ``depth``: words that are equal without that letter."""
    head, letter = F.expr("substring(spelled, 1, depth)"), F.expr("substring(spelled, depth + 1, 1)")
    room = F.when(F.col("backward"), F.col("depth") + SHARED).otherwise(F.length("spelled"))  # backward: few letters behind
    short = crowd.filter(F.length("spelled") <= room).withColumn("letter", letter)
    without = short.filter(F.col("letter") != "").withColumn("rest", F.concat(head, F.expr("substring(spelled, depth + 2)")))
    both = without.unionByName(short.withColumn("rest", F.col("spelled")))
    word = F.when(F.col("backward"), F.reverse("spelled")).otherwise(F.col("spelled"))
    grouped = (both.groupBy("backward", "prefix", "rest")
               .agg(F.collect_list(F.struct((-F.col("n")).alias("rank"), word.alias("word"), "letter")).alias("all"))
               .filter(F.size("all") > 1))  # words that differ in one letter, and the one without: an alphabet at most
    each = grouped.select("backward", "all", F.explode("all").alias("x"))
    start = lambda c: F.substring(c, 1, SHARED)
    others = F.filter("all", lambda y: (y["letter"] != F.col("x.letter"))
                      & (~F.col("backward") | (start(y["word"]) != start(F.col("x.word")))))
    return (each.select("x.word", F.transform(others, lambda y: F.struct(y["rank"].alias("rank"), y["word"].alias("word"))).alias("others"))
            .filter(F.size("others") > 0)
            .select("word", F.size("others").cast("bigint").alias("n_near"), F.array_min("others").alias("best")))


def _shared(a: str, b: str) -> Column:
    """How many first letters two columns share."""
    least = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), least), lambda i: F.substring(F.col(a), i, F.lit(1)) != F.substring(F.col(b), i, F.lit(1)))
    return F.coalesce(F.get(differs, 0) - 1, least)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best: negated count and spelling) of every word of (word, n) that has near words."""
    sides = F.array(F.struct(F.lit(False).alias("backward"), F.col("word").alias("spelled")),
                    F.struct(F.lit(True).alias("backward"), F.reverse("word").alias("spelled")))
    open_ = vocabulary.select(F.explode(sides).alias("s"), "n").select("s.backward", "s.spelled", "n")
    open_ = open_.withColumn("prefix", F.substring("spelled", 1, SHARED))
    ready, found = [], []
    while True:
        sizes = open_.groupBy("backward", "prefix").agg(F.count(F.lit(1)).alias("size"), F.min("spelled").alias("a"),
                                                        F.max("spelled").alias("b"))
        large = store(sizes.filter(F.col("size") > GROUP).select("backward", "prefix", _shared("a", "b").alias("depth")), "large")
        count = large.count()
        if not count:
            ready.append(open_)
            break
        large = F.broadcast(large) if count <= SMALL else large
        ready.append(open_.join(large, ["backward", "prefix"], "left_anti"))
        crowd = store(open_.join(large, ["backward", "prefix"]), "crowd")
        found.append(_at_branching(crowd))
        open_ = crowd.filter(F.length("spelled") > F.col("depth")).select(
            "backward", "spelled", "n", F.expr("substring(spelled, 1, depth + 1)").alias("prefix"))
    parts = ready[0]
    for more in ready[1:]:
        parts = parts.unionByName(more)
    near = (parts.select("backward", "prefix", "spelled", "n").repartition("backward", "prefix")
            .sortWithinPartitions("backward", "prefix").mapInArrow(_parts, PART))
    for more in found:
        near = near.unionByName(more)
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word of each chain, by doubling steps."""
    at = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = store(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                           F.col("next").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def group(vocabulary: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a stored vocabulary (word, n)."""
    best = near_words(vocabulary)
    count = -F.col("best.rank")
    taken = count >= F.col("n") * RATIO
    out = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"),
        F.when(taken, count).alias("form_n"))
    out = store(out, "forms")
    last = roots(out.filter(F.col("form").isNotNull()))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, folder: str) -> DataFrame:
    """Variants of all words of all documents."""
    return group(store(words(spark.read.parquet(f"{folder}/documents.parquet")), "vocabulary"))


# The same in DuckDB SQL: words that are equal without one letter are near, or a word and the other without a letter.
# 3988292384 and 4294967295 are the fixed values of the public crc32.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
runs AS (
  SELECT translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, coalesce(doc_id::VARCHAR, '') AS k, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents) GROUP BY ALL),
bytes AS (
  SELECT run, times, hex(encode(k || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
           lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM bytes, crc),
vocabulary AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (
  SELECT word, n, 0 AS p, word AS rest FROM vocabulary
  UNION ALL SELECT word, n, p, word[:p - 1] || word[p + 1:] FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary)),
links AS (
  SELECT DISTINCT a.word AS a, a.n AS n, b.word AS b, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.word <> b.word
  WHERE a.p = b.p OR a.p = 0 OR b.p = 0),
near AS (
  SELECT a AS word, count(*) AS n_near, max(m) AS top, first(b ORDER BY m DESC, b) AS best FROM links GROUP BY a),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN best END AS form,
         CASE WHEN top >= 10 * v.n THEN top END AS form_n
  FROM vocabulary v LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM chain c JOIN forms f ON f.form = c.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""
