"""Document fingerprints by Order MinHash: sensitive to edits and to the order of passages, not only to their presence.

A text is the sequence of its ``K``-mers of code points, each numbered by its occurrence (the third "the same " differs from
the first). ``COORDINATES`` keyed permutations order these numbered k-mers; each picks its ``PICKED`` least ones, puts them back
in text order and hashes the tuple to 16 bits. The likeness of two fingerprints is the share of equal coordinates.

``with_next`` also compares every row with its successor by descending key. Rows are range-partitioned and sorted once; a
task streams its range, keeping one row back, and hands on only its first and last row, which a small second step links
across the ranges. So each text is shuffled once and no task holds more than two texts besides a batch.

Defined cases: a null text is the empty text; the empty text has the all-zero fingerprint, like itself (1.0) and unlike others;
a text of fewer than ``K`` code points is padded behind its end, so that every code point starts a k-mer; rows with equal
keys follow each other by a hash of their text, then by the text, and null keys come last; repeated rows are rows of their
own; a single row is its own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import column, store

K, PICKED, COORDINATES = 8, 2, 96
BLOCK = 4_096  # k-mers whose order is computed at a time, for all coordinates
SEED = 20_177


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(text: str) -> np.ndarray:
    """One 64-bit hash per code point: that of the ``K`` code points from there, behind the end a mark of its own."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    value = np.concatenate([codes, np.zeros(K - 1, np.uint64)])
    width, base = 1, 0x9E3779B97F4A7C15
    while width < K:  # widths 1, 2, 4, ..: a window is two half windows
        value = value[:-width] * np.uint64(base) + value[width:]
        width, base = width * 2, base * base % (1 << 64)
    return _mix(value)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal values precede each one."""
    bits = np.uint64(len(hashes).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort(hashes & ~low | np.arange(len(hashes), dtype=np.uint64))  # equal values lie together, in text order
    group = packed >> bits
    place = np.arange(len(hashes))
    start = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], place, 0))
    out = np.empty(len(hashes), np.uint64)
    out[(packed & low).astype(np.int64)] = place - start
    return out


class Sketcher:
    """Fingerprints of texts; its permutations depend on the seed only."""

    def __init__(self, coordinates: int = COORDINATES, picked: int = PICKED, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.factor = (rng.integers(0, 1 << 31, coordinates, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]
        self.shift = rng.integers(0, 1 << 32, coordinates, dtype=np.uint32)[:, None]
        self.coordinates, self.picked = coordinates, picked

    def _least(self, items: np.ndarray) -> np.ndarray:
        """Positions of each coordinate's least items, in text order: coordinates x min(picked, items)."""
        low, row, found = (items >> np.uint64(32)).astype(np.uint32), np.arange(self.coordinates), []
        for start in range(0, len(items), BLOCK):
            order = low[None, start:start + BLOCK] * self.factor
            order += self.shift
            for i in range(min(self.picked, order.shape[1])):
                if i:
                    order[row, at] = 0xFFFFFFFF
                at = order.argmin(axis=1)
                found.append(order[row, at].astype(np.uint64) << np.uint64(32) | (at + start).astype(np.uint64))
        found = np.stack(found, axis=1)
        found.sort(axis=1)  # by value, then by position
        return np.sort((found[:, :self.picked] & np.uint64(0xFFFFFFFF)).astype(np.int64), axis=1)

    def sketch(self, text: str) -> np.ndarray:
        """One unsigned 16-bit value per coordinate; zero only for the empty text."""
        if not text:
            return np.zeros(self.coordinates, "<u2")
        hashes = kmers(text)
        items = _mix(hashes + occurrences(hashes) * np.uint64(0xD6E8FEB86659FD93))
        chosen = hashes[self._least(items)]
        value = np.full(self.coordinates, chosen.shape[1], np.uint64)
        for i in range(chosen.shape[1]):
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
        return (value % np.uint64(65_535) + np.uint64(1)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal coordinates."""
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """``text`` whose second half (rounded down) is replaced by as many code points from the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compared(sketcher: Sketcher, text: str, own: np.ndarray, following: str, next_sketch: np.ndarray) -> tuple:
    changed = edited(text, following)
    print_ = sketcher.sketch(changed)
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), own.tobytes(), print_.tobytes(),
            likeness(own, print_), likeness(own, next_sketch))


RESULT = ("n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, "
          "near_next double")
INNER, FIRST, LAST = 0, 1, 2


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint) per row, the fingerprint as lowercase hex."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()),
                 pa.array([sketcher.sketch(t).tobytes() for t in texts], pa.binary())], names=["key", "n_chars", "fingerprint"])

    rows = df.select(column(key).alias("key"), column(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_chars bigint, fingerprint binary")
    return out.select(F.col("key").alias(key), "n_chars", F.lower(F.hex("fingerprint")).alias("fingerprint"))


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The successor is the next row by descending key; that of the last row is the first one.
    """
    rows = df.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType
    order = [F.desc_nulls_last("key"), F.asc("h"), F.asc("text")]
    placed = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    arrow = placed.select("key", "text")
    stream = store(arrow.mapInArrow(_stream, f"key {kind.simpleString()}, {RESULT}, part int, place int, text string"), "order")

    firsts = stream.filter(F.col("place") == FIRST).select("part", F.col("text").alias("following"))
    parts = firsts.select("part")  # one row per range
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0))))
    links = parts.select("part", following.alias("next"))
    ends = (stream.filter(F.col("place") == LAST).select("key", "text", "part").join(links, "part")
            .join(firsts.withColumnRenamed("part", "next"), "next").select("key", "text", "following"))
    ends = ends.mapInArrow(_linked, f"key {kind.simpleString()}, {RESULT}")
    out = stream.filter(F.col("place") == INNER).select(*ends.columns).unionByName(ends)
    hexed = lambda name: F.lower(F.hex(name)).alias(name)
    return out.select(F.col("key").alias(key), "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"),
                      "near_edited", "near_next")


def _table(key_type: pa.DataType, rows: list[tuple], extra: bool) -> pa.RecordBatch:
    kinds = [key_type, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if extra:
        kinds, names = kinds + [pa.int32(), pa.int32(), pa.string()], names + ["part", "place", "text"]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: all but the last compared with the next; the first and the last handed on with their text."""
    sketcher, part, held, kind, none = Sketcher(), TaskContext.get().partitionId(), None, None, (None,) * 6
    for batch in batches:
        out, kind = [], batch.column(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = held[2] if held and held[1] == text else sketcher.sketch(text)
            if held:
                out.append((held[0], *_compared(sketcher, held[1], held[2], text, own), part, INNER, None))
            else:
                out.append((key, *none, part, FIRST, text))
            held = key, text, own
        yield _table(kind, out, True)
    if held:
        yield _table(kind, [(held[0], *none, part, LAST, held[1])], True)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of the ranges compared with the first of the next range."""
    sketcher = Sketcher()
    for batch in batches:
        yield _table(batch.column(0).type, [
            (key, *_compared(sketcher, text, sketcher.sketch(text), following, sketcher.sketch(following)))
            for key, text, following in zip(*(c.to_pylist() for c in batch.columns))], False)


def query(spark, folder: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness to those and to the next document."""
    return with_next(spark.read.parquet(f"{folder}/documents.parquet"))
