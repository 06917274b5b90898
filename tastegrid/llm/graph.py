"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on the least node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    hung = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, label) after one step of joining along links (a, b) of ids: every label takes the least one it meets.

    A step need not join all that is connected; what gets one label always is.
    """
    of = lambda name, as_: labels.select(F.col("id").alias(name), F.col("label").alias(as_))
    met = links.join(of("a", "x"), "a").join(of("b", "y"), "b").filter("x != y")
    hook = store(met.groupBy(F.greatest("x", "y").alias("label")).agg(F.min(F.least("x", "y")).alias("to")), "hooks")
    further = hook.select(F.col("label").alias("to"), F.col("to").alias("next"))
    hook = hook.join(further, "to", "left").select("label", F.coalesce("next", "to").alias("to"))
    return labels.join(hook, "label", "left").select("id", F.coalesce("to", "label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node that it reaches.

    Edges keep a > b. Both steps aggregate before they shuffle, and their joins have no aggregate above them, so a node
    with very many neighbours is dealt over tasks by the skew join. The rounds grow with the logarithm of the nodes;
    they end when a round changes nothing. Empty edges give no rows; loops and nulls are left out.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a != b").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        edges = store(_small_star(_large_star(edges)).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
