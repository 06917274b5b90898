"""Sparse matrix product as a join, with hot inner keys multiplied block by block.

For an inner key shared by ``a`` left rows and ``b`` right rows a join would make a*b rows. Keys
where that stays within ``pair_budget`` are joined and pre-aggregated by Spark. Hotter keys take
another exact route: their rows are spread over (row block, column block, key block) cells and each
cell is multiplied as a small dense matrix, so no task sees a hot key whole, nothing is emitted per
pair of rows, and no entry is left out. Cells hold at most block*block entries a side, whatever
the skew, because each side has one entry per (row, key).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_BUDGET = 1 << 20
BLOCK = 1024


def sparse_product(left: DataFrame, right: DataFrame, pair_budget: int | None = None,
                   block: int | None = None) -> DataFrame:
    """left(i, k, x) times right(k, j, y) -> (i, j, v) with v = sum over k of x*y.

    Each side must hold one row per (row, key).
    """
    budget = pair_budget or PAIR_BUDGET
    ca = left.groupBy("k").agg(F.count(F.lit(1)).alias("ca"))
    cb = right.groupBy("k").agg(F.count(F.lit(1)).alias("cb"))
    hot = ca.join(cb, "k").filter(F.col("ca").cast("double") * F.col("cb") > budget).select("k")
    light = (left.join(hot, "k", "left_anti").join(right, "k")
             .groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")))
    if hot.isEmpty():
        return light
    heavy = _blocked(left.join(hot, "k", "left_semi"), right.join(hot, "k", "left_semi"), block or BLOCK)
    return light.unionByName(heavy).groupBy("i", "j").agg(F.sum("v").alias("v"))


def _block_of(column: str, count: int):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(count)).cast("int")


def _blocks(df: DataFrame, column: str, block: int) -> int:
    """Blocks of about ``block`` distinct values; only the number comes to the driver."""
    return max(1, -(-df.select(column).distinct().count() // block))


def _multiply(cell: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    if a.empty or b.empty:
        return pd.DataFrame({"i": pd.Series(dtype=str), "j": pd.Series(dtype=str), "v": pd.Series(dtype=float)})
    keys = pd.Index(np.union1d(a["k"].unique(), b["k"].unique()))
    ai, rows = pd.factorize(a["i"])
    bj, cols = pd.factorize(b["j"])
    dense_a = np.zeros((len(rows), len(keys)))
    dense_b = np.zeros((len(keys), len(cols)))
    dense_a[ai, keys.get_indexer(a["k"])] = a["x"].to_numpy(dtype=float)
    dense_b[keys.get_indexer(b["k"]), bj] = b["y"].to_numpy(dtype=float)
    out = dense_a @ dense_b
    touched = (dense_a != 0).astype(np.float32) @ (dense_b != 0).astype(np.float32)
    r, c = np.nonzero(touched)
    return pd.DataFrame({"i": np.asarray(rows)[r], "j": np.asarray(cols)[c], "v": out[r, c]})


def _blocked(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    ni, nj, nk = _blocks(left, "i", block), _blocks(right, "j", block), _blocks(left, "k", block)
    a = left.select(
        _block_of("i", ni).alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(nj - 1))).alias("jb"),
        _block_of("k", nk).alias("kb"), "i", "k", F.col("x").cast("double").alias("x"))
    b = right.select(
        F.explode(F.sequence(F.lit(0), F.lit(ni - 1))).alias("ib"), _block_of("j", nj).alias("jb"),
        _block_of("k", nk).alias("kb"), "k", "j", F.col("y").cast("double").alias("y"))
    cells = a.groupBy("ib", "jb", "kb").cogroup(b.groupBy("ib", "jb", "kb"))
    return cells.applyInPandas(_multiply, "i string, j string, v double")
