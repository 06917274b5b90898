"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three characters of the lower-cased text are hashed to ``BUCKETS`` features. Document frequencies come from
all training documents. The classifier is fitted with follow-the-regularised-leader (per-coordinate rates, elastic net) on a
sample of about ``PER_LANGUAGE`` training documents of each language, all of them where there are fewer; one in five of the
sample is held back to find the temperature that calibrates the probabilities. Prediction reads the whole text and nothing
else. A feature's value is its count times its inverse document frequency, over the root of the summed squares of the
frequencies of all occurrences, so scores are plain sums over occurrences and more text gives more certainty.

Defined cases: a null text and a text without a letter are ``und`` with score 0; without any training document every text is
``und``; rows without a language never train; equal scores go to the language that sorts first; repeated rows count each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import Shared, column, remainder
from tastegrid.llm.sketch import mix, slices

BITS = 15
BUCKETS = 1 << BITS
LONGEST = 3
PER_LANGUAGE = 600
MOST_LANGUAGES = 2_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"


def features(text: str) -> np.ndarray:
    """The bucket of every occurrence of an n-gram; a blank stands on both sides of the text."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, gram = [], np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        gram = gram[:len(points) - n + 1] * np.uint64(0x110000) + points[n - 1:]
        out.append(mix(gram + np.uint64(n << 60)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of a partition's texts; bucket -1 counts the texts."""
    counts, total = np.zeros(BUCKETS, np.int64), 0
    seen = np.zeros(BUCKETS, bool)
    for batch in batches:
        for x in batch.column(0):
            found = features(x.as_py())
            seen[found] = True
            counts += seen
            seen[found] = False
            total += 1
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used]), pa.array(np.r_[total, counts[used]])],
                                     names=["bucket", "n"])


def sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, language, buckets, counts) of sampled texts; at most BUCKETS pairs each."""
    for batch in batches:
        sparse = [np.unique(features(x.as_py()), return_counts=True) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([b.astype("<u2").tobytes() for b, _ in sparse], pa.binary()),
             pa.array([c.astype("<u4").tobytes() for _, c in sparse], pa.binary())],
            names=["place", "language", "buckets", "counts"])


class Leader:
    """Follow-the-regularised-leader for softmax regression."""

    def __init__(self, size: int, classes: int):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax((x @ w)[None])[0]
        error[label] -= 1
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood, by golden section on its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / math.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


class Model:
    """Languages, inverse document frequencies, weights (already times those), bias and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.idf, self.bias, self.heat = languages, idf, bias, 1.0
        self.weights = idf[:, None] * weights
        self.squares = idf * idf

    def logits(self, found: np.ndarray) -> np.ndarray:
        return self.weights[found].sum(axis=0) / math.sqrt(self.squares[found].sum()) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.logits(features(text)) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit_model(sample: list[tuple], languages: list[str], idf: np.ndarray) -> Model:
    """``sample``: (place, language, buckets, counts) in the order to learn in."""
    number = {name: i for i, name in enumerate(languages)}
    rows = []
    for place, language, buckets, counts in sample:
        at = np.frombuffer(buckets, "<u2").astype(np.int64)
        count = np.frombuffer(counts, "<u4").astype(float)
        x = count * idf[at] / math.sqrt((count * idf[at] ** 2).sum())
        rows.append((np.r_[at, BUCKETS], np.r_[x, 1.0], number[language]))
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    learner = Leader(BUCKETS + 1, len(languages))
    for _ in range(EPOCHS):
        for i, (at, x, label) in enumerate(rows):
            if i % 5 != 4:
                learner.learn(at, x, label)
    weights = learner.weights(np.arange(BUCKETS + 1))
    model = Model(languages, idf, weights[:-1], weights[-1])
    if held and len(languages) > 1:
        logits = np.stack([x @ weights[at] for at, x, _ in held])
        model.heat = temperature(logits, np.array([label for *_, label in held]))
    return model


def train(df: DataFrame, condition: Column, text: str = "text", language: str = "lang", key: str = "doc_id") -> Model | None:
    """A model of the rows that meet the condition and have a text and a language; None if there are none."""
    whole = column(text).cast("string")
    rows = df.filter(condition & whole.isNotNull() & column(language).isNotNull()).select(
        column(key).alias("key"), column(language).cast("string").alias("language"), whole.alias("text"))
    sizes = {r["language"]: r["n"] for r in rows.groupBy("language").agg(F.count("*").alias("n"))
             .limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counted = rows.select("text").mapInArrow(document_frequencies, "bucket bigint, n bigint")
    found = {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = found.pop(-1)
    idf = np.full(BUCKETS, math.log(1 + total) + 1)
    idf[list(found)] = np.log((1 + total) / (1 + np.array(list(found.values())))) + 1

    place = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))
    uniform = F.conv(F.substring(place, 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.lit(1.0)
    for name, n in sizes.items():
        rate = F.when(F.col("language") == name, min(1.0, PER_LANGUAGE / n)).otherwise(rate)
    picked = rows.filter(uniform < rate).select(F.substring(place, 9, 16).alias("place"), "language", "text")
    sample = picked.mapInArrow(sampled_features, "place string, language string, buckets binary, counts binary").collect()
    return fit_model(sorted(tuple(r) for r in sample), sorted(sizes), idf)


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) per row."""
    shared = Shared(df.sparkSession, model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, known = regex.compile(r"\p{L}"), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                out = [known.predict(t) if known and t and letter.search(t) else (UNKNOWN, 0.0) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x for x, _ in out], pa.string()),
                     pa.array([y for _, y in out], pa.float64())], names=["key", "lang_pred", "score"])

    rows = df.select(column(key).alias("key"), column(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def query(spark, folder: str) -> DataFrame:
    """The language of every document, by a model of those whose remainder modulo 3 isn't 1."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 3) == 1
    out = predict(docs, train(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
