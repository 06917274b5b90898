"""A fitted pointwise click scorer from Spark's own ML library, and a batch wrapper for others."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tastegrid.functions.hashing import u01


def assemble_samples(samples: DataFrame, hashed: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    """Array columns as ML vectors; hashed columns as text, so that every id is a category of its own."""
    return samples.withColumns({f"_{v}": array_to_vector(F.col(v)) for v in vectors}
                               | {f"_{c}": F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in hashed})


def fit_scorer(samples: DataFrame, hashed: Sequence[str], vectors: Sequence[str], kind: str = "fm", buckets: int = 1 << 14,
               factors: int = 8, iterations: int = 30, step: float = 0.05, reg: float = 1e-4) -> PipelineModel:
    """Fit on (label, categories, array columns) with log-loss: factorisation machine or logistic.

    Categories such as users, items and tags are hashed into ``buckets`` places: no dictionary of ids is built, the model's
    size doesn't grow with them, and ids that come up later have a place too.
    """
    hasher = FeatureHasher(inputCols=[f"_{c}" for c in hashed], outputCol="_hashed", numFeatures=buckets)
    assembler = VectorAssembler(inputCols=["_hashed"] + [f"_{v}" for v in vectors], outputCol="_features")
    if kind == "fm":
        model = FMClassifier(featuresCol="_features", labelCol="label", factorSize=factors, maxIter=iterations,
                             stepSize=step, regParam=reg, solver="adamW", seed=42)
    elif kind == "logistic":
        model = LogisticRegression(featuresCol="_features", labelCol="label", maxIter=iterations, regParam=reg)
    else:
        raise ValueError(f"unknown scorer: {kind}")
    return Pipeline(stages=[hasher, assembler, model]).fit(assemble_samples(samples, hashed, vectors))


def apply_scorer(model: PipelineModel, pairs: DataFrame, hashed: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    """Add the click probability as ``score``."""
    scored = model.transform(assemble_samples(pairs, hashed, vectors))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*pairs.columns, "score")


def split_samples(samples: DataFrame, share: float = 0.2, key: Sequence[str] = ("user_id", "item_id"), seed: int = 42
                  ) -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows): a row's side follows from its key, so repeats of a pair stay on one side."""
    held = u01(*key, seed=seed) < share
    return samples.filter(~held), samples.filter(held)


def batch_scorer(make: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, batch_size: int = 256
                 ) -> Callable[[Column], Column]:
    """Wrap a numpy model over feature arrays of ``width`` numbers; loaded once per Python worker."""
    return predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]])
