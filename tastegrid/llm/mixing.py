"""Mixing sources to target weights by hierarchical budgeting.

The sources form a tree: domain, language, source. A token budget goes down the tree. At every node the children share their
parent's budget by weight; a child whose whole subtree can't use its share (its documents times ``max_epochs``) takes what it
can, and the rest goes to its siblings by their weights. As a node's capacity is that of its subtree, a shortage is made
good by siblings first and reaches other branches only where a whole branch runs short. Shares are whole tokens, rounded
down.

A leaf's budget is spent on whole epochs and the prefix of one more. Each epoch orders the leaf's documents by its own
seeded key; the prefix ends before the first document that would exceed the budget. A prefix is kept as the key of its last
document, one row per leaf, so documents are chosen without shuffling texts. Running sums first go over 4,096 ranges of keys
per leaf and then inside the one range where the prefix ends, so a leaf with most of all rows is never in one task.

Defined cases: a null text has no tokens and is chosen along with its place in the order; null names are the name ``''``;
rows with the same id are chosen together; a null id counts as ``''``; nodes without weight in the tables weigh 1; an empty
table gives no rows; other columns pass through ``select``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastegrid.llm.common import column, finish, fresh, store, stored

LEVELS = ("domain", "language", "source")
# The domains that stand in for a curated map of sources, as ``documents`` names none.
DOMAINS = ("web", "reference", "forum", "archive")
BROADCAST_LEAVES = 20_000  # leaves have three names and three numbers: some 100 bytes each, 2 MB at most


@dataclass(frozen=True)
class Plan:
    """Weights by level and name (whole numbers), the share of all tokens to choose, and how often a text may repeat."""

    weights: dict = field(default_factory=lambda: {
        "domain": {"web": 4, "reference": 3, "forum": 2, "archive": 1},
        "language": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}})
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 42


def domain_of(source: Column) -> Column:
    """A domain for every source, by a hash of its name."""
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]),
                        (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % len(DOMAINS) + 1).cast("int"))


def _weight(level: str, plan: Plan) -> Column:
    out = F.lit(1)
    for name, w in plan.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("bigint")


def order_key(key: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in one epoch: a seeded hash, then the id."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.concat_ws(":", F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), text)), text)


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (weight, cap, given = their parent's budget) with ``budget``: by weight, no child above its cap.

    Children are taken by cap / weight: one is filled up if its cap is at most its share of what is then left.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")).asc_nulls_last(), name)
    past, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy(*parent)
    left = F.col("given") - F.coalesce(F.sum("cap").over(past), F.lit(0))
    out = children.filter("weight > 0").withColumn(
        "filled", F.col("cap") * F.sum("weight").over(rest) <= F.col("weight") * left)
    open_budget = F.col("given") - F.coalesce(F.sum(F.when(F.col("filled"), F.col("cap"))).over(all_), F.lit(0))
    open_weight = F.sum(F.when(~F.col("filled"), F.col("weight"))).over(all_)
    out = out.withColumn("part", F.col("weight") * open_budget).withColumn("whole", open_weight)
    return out.withColumn("budget", F.when(F.col("filled"), F.col("cap")).otherwise(F.expr("part div whole"))) \
        .drop("filled", "part", "whole", "given")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """``leaves`` (domain, language, source, tokens) with each leaf's ``budget``."""
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("cap"), F.lit(0)).alias("c"))
    given = total.select(F.least(F.expr(f"t * {plan.budget_percent} div 100"), F.col("c")).alias("given"))
    nodes = given.withColumn("root", F.lit(0))
    for depth, level in enumerate(LEVELS):
        path = [*LEVELS[:depth + 1]]
        children = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        children = children.withColumn("weight", _weight(level, plan)).withColumn("root", F.lit(0))
        parent = ["root", *path[:-1]]
        nodes = share(children.join(nodes.select(*parent, "given"), parent), parent, level)
        nodes = nodes.withColumnRenamed("budget", "given")
    return nodes.select(*LEVELS, "tokens", F.col("given").alias("budget"))


def _near(df: DataFrame, leaves: DataFrame, n: int, on) -> DataFrame:
    """Join with a table of one row per leaf: broadcast up to a counted bound, else shuffled with skewed leaves split."""
    return df.join(F.broadcast(leaves) if n <= BROADCAST_LEAVES else leaves, on)


def cutoffs(sizes: DataFrame, plan: Plan) -> tuple[DataFrame, int]:
    """One row per leaf with a budget: (names, epochs, cutoff, budget), and how many rows that is.

    ``sizes`` has (key, domain, language, source, n_tokens). Every document is chosen ``epochs`` times, and once more if its
    key in epoch number ``epochs`` is at most ``cutoff``.
    """
    mark = stored()
    sizes = store(sizes, "sizes")
    by = [*LEVELS]
    leaves = budgets(sizes.groupBy(*by).agg(F.sum("n_tokens").alias("tokens")), plan)
    # a leaf without tokens costs nothing: all of its documents are chosen, once
    rounds = F.when(F.col("tokens") == 0, F.lit(1)).otherwise(F.expr("budget div greatest(tokens, 1)"))
    leaves = leaves.select(*by, "budget", rounds.cast("bigint").alias("epochs"),
                           (F.col("budget") - F.col("tokens") * rounds).alias("rest"))
    leaves = store(leaves, "leaves")
    n = leaves.count()
    ordered = _near(sizes, leaves, n, by).withColumn("place", order_key(F.col("key"), F.col("epochs"), plan.seed))
    ordered = ordered.withColumn("range", F.substring("place", 1, 3))

    ranges = ordered.groupBy(*by, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"),
                                               F.max("place").alias("top"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("range"))
    ranges = store(ranges.withColumn("upto", upto), "ranges")
    full = ranges.filter("upto <= rest").groupBy(*by).agg(F.max("top").alias("full"))
    edge = ranges.filter("upto > rest").groupBy(*by).agg(F.min("range").alias("range"),
                                                         F.min(F.struct("range", F.expr("upto - n").alias("before")))
                                                         .alias("edge"))
    edge = edge.select(*by, "range", F.col("edge.before").alias("before"))
    inside = _near(ordered, edge, n, [*by, "range"])
    peers = Window.partitionBy(*by).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum("n_tokens").over(peers) + F.col("before")).filter("upto <= rest")
    inside = inside.groupBy(*by).agg(F.max("place").alias("inside"))
    ends = full.unionByName(inside.withColumnRenamed("inside", "full")).groupBy(*by).agg(F.max("full").alias("cutoff"))
    out = leaves.join(ends, by, "left").select(*by, "epochs", F.coalesce("cutoff", F.lit("")).alias("cutoff"), "budget")
    return finish(out, "cutoffs", mark), n


def select(df: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text", source: str = "source",
           language: str = "lang", tokens: Column | None = None) -> tuple[DataFrame, str]:
    """The chosen rows of ``df`` and the name of their added struct (domain, language, source, n_tokens, copies).

    ``tokens`` counts a row's tokens; by default words, which white space parts.
    """
    name = fresh(df, "mix")
    counted = F.regexp_count(F.coalesce(column(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    counted = (counted if tokens is None else tokens).cast("bigint")
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = [domain_of(column(source)).alias("domain"), named(column(language)).alias("language"),
            named(column(source)).alias("source")]
    ends, n = cutoffs(df.select(column(key).alias("key"), *leaf, counted.alias("n_tokens")), plan)
    ends = ends.select(F.struct(*LEVELS).alias("__leaf"), F.col("epochs").alias("__epochs"),
                       F.col("cutoff").alias("__cutoff"))
    out = df.withColumn(name, F.struct(*leaf))
    out = _near(out, ends, n, F.col(name) == F.col("__leaf"))
    once_more = (order_key(column(key), F.col("__epochs"), plan.seed) <= F.col("__cutoff")).cast("bigint")
    out = out.withColumn(name, F.struct(*[F.col(name)[c].alias(c) for c in LEVELS],
                                        (F.col("__epochs") + once_more).alias("copies"))).drop(
        "__leaf", "__epochs", "__cutoff")
    return out.filter(F.col(name)["copies"] > 0), name


def choose(df: DataFrame, plan: Plan, **names) -> DataFrame:
    """The chosen rows with their own columns only, each as often as it is chosen."""
    out, name = select(df, plan, **names)
    if plan.max_epochs > 1:
        out = out.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)["copies"])))
    return out.drop(name)


def query(spark, folder: str) -> DataFrame:
    """The production mix over all documents: what is chosen, how often, and from which leaf."""
    out, name = select(spark.read.parquet(f"{folder}/documents.parquet"), Plan())
    return out.select("doc_id", *[F.col(name)[c].alias(c) for c in (*LEVELS, "copies")])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS language,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
m(source, domain) AS (VALUES {domains}),
s AS (SELECT d.*, m.domain FROM d JOIN m USING (source)),
leaf AS (SELECT domain, language, source, sum(n)::BIGINT AS tokens, sum(n)::BIGINT * 2 AS cap FROM s GROUP BY ALL),
w1 AS (SELECT domain, sum(cap)::BIGINT AS cap,
    CASE domain WHEN 'web' THEN 4 WHEN 'reference' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END::BIGINT AS weight,
    (SELECT least(sum(tokens) * 60 // 100, sum(cap)) FROM leaf)::BIGINT AS given FROM leaf GROUP BY domain),
f1 AS (SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (given - coalesce(sum(cap) OVER (ORDER BY cap / weight, domain
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM w1),
b1 AS (SELECT domain, CASE WHEN filled THEN cap ELSE weight * (given - coalesce(sum(cap) FILTER (filled) OVER (), 0))
    // sum(weight) FILTER (NOT filled) OVER () END::BIGINT AS given FROM f1),
w2 AS (SELECT domain, language, sum(cap)::BIGINT AS cap,
    CASE language WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::BIGINT AS weight,
    any_value(given) AS given FROM leaf JOIN b1 USING (domain) GROUP BY domain, language),
f2 AS (SELECT *, cap * sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, language
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (given - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, language
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM w2),
b2 AS (SELECT domain, language, CASE WHEN filled THEN cap
    ELSE weight * (given - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY domain), 0))
    // sum(weight) FILTER (NOT filled) OVER (PARTITION BY domain) END::BIGINT AS given FROM f2),
w3 AS (SELECT leaf.*, 1::BIGINT AS weight, given FROM leaf JOIN b2 USING (domain, language)),
f3 AS (SELECT *, cap * sum(weight) OVER (PARTITION BY domain, language ORDER BY cap / weight, source
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (given - coalesce(sum(cap) OVER (PARTITION BY domain, language ORDER BY cap / weight, source
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM w3),
b3 AS (SELECT domain, language, source, tokens, CASE WHEN filled THEN cap
    ELSE weight * (given - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY domain, language), 0))
    // sum(weight) FILTER (NOT filled) OVER (PARTITION BY domain, language) END::BIGINT AS budget FROM f3),
e AS (SELECT *, CASE WHEN tokens = 0 THEN 1 ELSE budget // greatest(tokens, 1) END AS epochs FROM b3),
k AS (SELECT s.*, epochs, budget - tokens * epochs AS rest,
    md5('42:' || epochs || ':' || doc_id) || ':' || doc_id AS place FROM s JOIN e USING (domain, language, source)),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, language, source ORDER BY place) <= rest AS more FROM k)
SELECT doc_id, domain, language, source, (epochs + CASE WHEN more THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c WHERE more OR epochs > 0
"""


def oracle() -> str:
    """The SQL; DuckDB has no crc32, so the domains of the test tables' sources are listed."""
    import zlib

    sources = ["", *(f"src{i}" for i in range(100))]
    rows = ", ".join(f"('{s}', '{DOMAINS[zlib.crc32(s.encode()) % len(DOMAINS)]}')" for s in sources)
    return ORACLE.replace("{domains}", rows)
