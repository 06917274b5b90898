"""Cosine similarity between items or users of the interaction count matrix, non-zero pairs only.

All pairs take one of three exact routes, none of which shuffles pairs but the last. Where no column is hot, each column's rows
travel as arrays to the rarer row of every pair, which adds up its pairs in its own task. Where pairs share columns more often
than not, blocks of whole rows, read where they are stored, meet in cells and a cell hands on finished cosines. What is left goes through ``sparse_product``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.operators.product import PAIR_BUDGET, sparse_product
from tastegrid.operators.ranking import dense_index, top_k
from tastegrid.session import cut, stored

CELL_ROWS = 2048          # rows of a block
CELL_COLUMNS = 2048       # columns multiplied at a time
CELL_OUT = 256            # rows of a block whose pairs are handed on at a time
CELL_LEAST, CELL_WIDTH = 1000, 4096  # fewer or, on average, wider rows are left to partial sums
TASK_PAIRS = 2_000_000    # pairs that a task adds up


def count_matrix(interactions: DataFrame) -> DataFrame:
    """(user_id, item_id, c): repeats add up."""
    return interactions.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("c"))


def _cosine(matrix: DataFrame, entity: str, via: str, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """(a, b, sim) of all pairs, or of those with ``a`` among the entities of ``rows`` and ``b`` among those of ``columns``."""
    if rows is None and columns is None:
        matrix = stored(matrix)
        per_column = matrix.groupBy(via).agg(F.count(F.lit(1)).cast("double").alias("n"))
        pairs, most = per_column.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0.0))).first()
        entries, entities = matrix.agg(F.count(F.lit(1)), F.count_distinct(entity)).first()
        if pairs < float(entities) * entities:
            if most * most <= PAIR_BUDGET:
                return _carried(matrix, entity, via, pairs)
        elif entities >= CELL_LEAST and entries <= entities * CELL_WIDTH:
            return _cells(matrix, entity, via, entities)
    only = lambda asked: matrix if asked is None else matrix.join(asked.select(entity).distinct(), entity, "left_semi")
    left = only(rows).select(F.col(entity).alias("i"), F.col(via).alias("k"), F.col("c").alias("x"))
    right = only(columns).select(F.col(entity).alias("j"), F.col(via).alias("k"), F.col("c").alias("y"))
    dots = sparse_product(left, right)
    square = matrix.groupBy(entity).agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    return (dots.join(square.select(F.col(entity).alias("i"), F.col("sq").alias("si")), "i")
            .join(square.select(F.col(entity).alias("j"), F.col("sq").alias("sj")), "j")
            .select(F.col("i").alias("a"), F.col("j").alias("b"),
                    (F.col("v") / (F.sqrt("si") * F.sqrt("sj"))).alias("sim")))


def _narrowest(most: int) -> str:
    """The shortest integer type that holds 0..``most``."""
    return next(kind for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if most < 1 << bits)


def _carried(matrix: DataFrame, entity: str, via: str, pairs: float) -> DataFrame:
    """Every pair is added up with its rarer member, so a frequent one never gathers all it occurs with.

    What travels is as narrow as the data allow: ids that are plain decimal numbers go as integers, from which the same text is
    made again, any other ids as they are; counts and squares go in the shortest type that holds the largest.
    """
    sizes = stored(matrix.groupBy(entity).agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.count(F.lit(1)).alias("n"), F.max("c").alias("c")))
    number = F.col(entity).try_cast("int")
    plain, most, square = sizes.agg(F.bool_and(F.coalesce(number.cast("string") == F.col(entity), F.lit(False))), F.max("c"), F.max("sq")).first()
    sizes = sizes.select(entity, "n", F.col("sq").cast(_narrowest(square or 0)).alias("sq"))
    member = F.struct(F.col("n"), (number if plain else F.col(entity)).alias("e"), F.col("c").cast(_narrowest(most or 0)).alias("c"), F.col("sq"))
    columns = matrix.join(sizes, entity).groupBy(via).agg(F.array_sort(F.collect_list(member)).alias("l"))
    parts = ("e", "c", "sq")
    split = columns.select(*[F.col(f"l.{f}").alias(f"l_{f}") for f in parts], F.posexplode("l").alias("at", "one"))
    later = [F.slice(f"l_{f}", F.col("at") + 1, F.size(f"l_{f}") - F.col("at")).alias(f) for f in parts]
    tasks = max(int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / 2 / TASK_PAIRS) + 1)
    sent = split.select(F.col("one.e").alias("i"), F.col("one.c").alias("x"), F.col("one.sq").alias("si"), *later).repartition(tasks, "i")
    met = sent.select("i", "x", "si", F.inline(F.arrays_zip(*parts)))
    dots = (met.select("i", "si", F.col("e").alias("j"), F.col("sq").alias("sj"), (F.col("x").cast("bigint") * F.col("c")).alias("v"))
            .groupBy("i", "si", "j", "sj").agg(F.sum("v").alias("v")))
    sim = (F.col("v") / (F.sqrt("si") * F.sqrt("sj"))).alias("sim")
    return _both_ways(dots.select(F.col("i").cast("string").alias("a"), F.col("j").cast("string").alias("b"), sim, (F.col("i") != F.col("j")).alias("twice")))


def _both_ways(half: DataFrame) -> DataFrame:
    one, other = F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    return half.select("sim", F.inline(F.when(F.col("twice"), F.array(one, other)).otherwise(F.array(one)))).select("a", "b", "sim")


def _cells(matrix: DataFrame, entity: str, via: str, entities: int) -> DataFrame:
    """Blocks of whole rows, each pair of blocks in one cell; a row must fit in a task.

    A block is packed into one stored row, which the tasks of its cells read where it lies (a nested-loop join without an
    exchange): blocks are shuffled once, not once per block that they meet, so only the result grows with the square.
    """
    columns = dense_index(matrix.select(via).distinct(), [F.col(via)], "k")
    rows = matrix.join(columns, via).groupBy(F.col(entity).alias("e")).agg(
        F.collect_list("k").alias("k"), F.collect_list(F.col("c").cast("double")).alias("c"))
    n = -(-entities // CELL_ROWS)
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("e"), F.lit(n)).cast("int"))
    blocks = cut(blocked.groupBy("block").applyInPandas(_packed, "block int, packed binary").repartitionByRange(n, "block"))
    left = blocks.select(F.col("block").alias("ib"), F.col("packed").alias("a"))
    right = blocks.select(F.col("block").alias("jb"), F.col("packed").alias("b"))
    cells = left.join(right.hint("shuffle_replicate_nl"), F.col("ib") <= F.col("jb"))
    return _both_ways(cells.mapInPandas(_cell_cosines, "a string, b string, sim double, twice boolean"))


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The block's names, entries (row, column, count) and lengths as one value."""
    row = np.repeat(np.arange(len(rows)), [len(k) for k in rows["k"]])
    k, c = np.concatenate(rows["k"].to_list()), np.concatenate(rows["c"].to_list())
    packed = pickle.dumps((rows["e"].to_numpy(), row, k, c, np.sqrt(np.bincount(row, c * c, len(rows)))), protocol=5)
    return pd.DataFrame({"block": [key[0]], "packed": [packed]})


def _cell_cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def dense(part: np.ndarray, row: np.ndarray, k: np.ndarray, c: np.ndarray, rows: int) -> np.ndarray:
        place = np.searchsorted(part, k)
        here = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == k)
        out = np.zeros((rows, len(part)))
        out[row[here], place[here]] = c[here]
        return out

    for batch in batches:
        for ib, a, jb, b in zip(batch["ib"], batch["a"], batch["jb"], batch["b"]):
            (ea, ra, ka, ca, la), (eb, rb, kb, cb, lb) = pickle.loads(a), pickle.loads(b)
            shared = np.intersect1d(ka, kb)
            dots = np.zeros((len(ea), len(eb)))
            for at in range(0, len(shared), CELL_COLUMNS):
                part = shared[at:at + CELL_COLUMNS]
                dots += dense(part, ra, ka, ca, len(ea)) @ dense(part, rb, kb, cb, len(eb)).T
            for at in range(0, len(ea), CELL_OUT):
                i, j = np.nonzero(dots[at:at + CELL_OUT])
                i += at
                yield pd.DataFrame({"a": ea[i], "b": eb[j], "sim": dots[i, j] / (la[i] * lb[j]), "twice": ib != jb})


def item_similarity(interactions: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """All pairs, or only from items of ``rows`` (such as the asked users' histories) to items of ``columns`` (the candidates)."""
    return _cosine(count_matrix(interactions), "item_id", "user_id", rows, columns)


def user_similarity(interactions: DataFrame) -> DataFrame:
    return _cosine(count_matrix(interactions), "user_id", "item_id")


def user_neighbors(similarity: DataFrame, k: int = 50) -> DataFrame:
    """The k most similar other users with positive similarity: (user_id, neighbor, sim, rank)."""
    others = similarity.filter((F.col("a") != F.col("b")) & (F.col("sim") > 1e-9)).select(
        F.col("a").alias("user_id"), F.col("b").alias("neighbor"), F.col("sim"))
    order = [F.round("sim", 9).desc(), F.col("neighbor")]
    return top_k(others, ["user_id"], order, k)
