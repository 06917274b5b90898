"""Training losses evaluated over tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.hashing import hash_key
from tastegrid.functions.numeric import clamp_probability
from tastegrid.functions.vectors import as_doubles
from tastegrid.operators.ranking import rank_within


BATCHES = 64  # batches whose ids one task ranks


def bce_loss(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    p, y = clamp_probability(F.col(score)), F.col(label)
    return scored.agg(F.avg(-(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias("bce"))


def _log_sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def contrastive_alignment(pairs: DataFrame, left: str, right: str, temperature: float = 0.07,
                          batch_size: int = 256, id_column: str = "item_id", seed: int = 42) -> DataFrame:
    """(batch_id, rows, loss): symmetric cross-entropy of paired vectors inside seeded mini-batches.

    Batches are cut here, by the rank of the id in hash order. Ids alone are ranked, in parts of a few batches; the vectors meet
    their batch's number afterwards, so no task sees more than ``batch_size`` of them. Ids are distinct and not null.
    """
    ids = pairs.select(F.col(id_column).alias("id"), hash_key(id_column, seed=seed).alias("_key"))
    ranked = rank_within(ids, [], "_key", [F.col("_key"), F.col("id")], task_rows=BATCHES * batch_size)
    numbered = ranked.select("id", F.floor((F.col("rn") - 1) / batch_size).cast("bigint").alias("batch_id"))
    vectors = pairs.select(F.col(id_column).alias("id"), as_doubles(F.col(left)).alias("a"), as_doubles(F.col(right)).alias("b"))
    batched = numbered.join(vectors, "id").select("batch_id", "a", "b")

    def loss(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for name in ("a", "b"):
            m = np.stack(batch[name].to_numpy())
            sides.append(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))
        logits = sides[0] @ sides[1].T / temperature
        own = np.diag(logits)
        value = ((_log_sum_exp(logits, 1) - own).mean() + (_log_sum_exp(logits, 0) - own).mean()) / 2
        return pd.DataFrame({"batch_id": [key[0]], "rows": [len(batch)], "loss": [float(value)]})

    return batched.groupBy("batch_id").applyInPandas(loss, "batch_id long, rows long, loss double")


def total_loss(bce: DataFrame, contrastive: DataFrame, bce_weight: float = 1.0, contrastive_weight: float = 0.1) -> DataFrame:
    """Weighted sum of the mean losses, with its parts."""
    aligned = contrastive.agg(F.coalesce(F.avg("loss"), F.lit(0.0))).scalar()
    return (bce.withColumn("contrastive", aligned)
            .select("bce", "contrastive",
                    (F.col("bce") * bce_weight + F.col("contrastive") * contrastive_weight).alias("total")))
