"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Texts with one and the same shingle set form a class; only one document of each class is compared. Sketches fill all of
their coordinates in rounds of hashed bin placement; bands of ``ROWS`` coordinates make buckets. With 64 bands of 5, a pair
at similarity 0.75 shares no bucket with a chance of 3e-8.

Links are found without listing a bucket's pairs:

1. every class is checked against the least member of its buckets, one pair per class;
2. buckets that still hold several components are compared blockwise by their sketches; each class is checked against its
   most similar partner of another component, round after round while a quarter or more of these pairs are links;
3. all partners of other components whose sketches don't rule out the threshold (more than 5 standard deviations below it)
   are checked; for this, sketches have ``BITS`` coordinates of one bit each.

Each check compares full shingle sets. After step 3 every candidate pair lies inside one component, was checked, or is
ruled out by its sketches.

Defined cases: a text that is null or without words has an empty set and links with nothing; repeated rows share their
class; rows with the same id count as one document; a row without an id links with nothing; ties go to the smaller id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import column, finish, store, stored
from tastegrid.llm.graph import components, joined
from tastegrid.llm.sketch import WordHashes, bands, fast_sketches, jaccard_at_least, shingle_set, slices

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 5, 64
BITS = 3072
BLOCK = 1024
_DEVIATIONS = 5.0


def least_matches(percent: int = PERCENT, coordinates: int = BITS) -> int:
    """Equal one-bit coordinates below which a pair is ruled out; unequal coordinates agree in their bit half the time."""
    p = (1 + percent / 100) / 2
    return int(coordinates * p - _DEVIATIONS * (coordinates * p * (1 - p)) ** 0.5)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = [shingle_set(t, hashes, size) for t in texts[a:b]]
                sizes = np.array([len(s) for s in sets])
                sketch = fast_sketches(np.concatenate(sets), sizes, ROWS * BANDS)
                keys = bands(sketch, ROWS)
                offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(sizes, pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                             pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                ], names=["id", "n_shingles", "digest", "bands"])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 20):
                sets = [shingle_set(t, hashes, size) for t in texts[a:b]]
                sketch = fast_sketches(np.concatenate(sets), np.array([len(s) for s in sets]), BITS)
                bits = np.packbits((sketch & np.uint64(1)).astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([row.tobytes() for row in bits], pa.binary())], names=["id", "shingles", "sketch"])
    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ok = [jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return store(both.mapInArrow(_linked(percent), "a bigint, b bigint"), name)


def _compare(least: int, best: bool):
    """Candidates inside runs of rows with one (key, i, j): (a, b, equal coordinates, key).

    Rows are (key, i, j, block, id, label, sketch, band, bands). A pair counts only in the bucket of the first band it
    shares, so it comes up once however many buckets it meets in.
    """

    def group(block, ids, labels, sketches, bands, band, i, j) -> list[tuple[np.ndarray, ...]]:
        if len(ids) < 2:
            return []
        own = np.flatnonzero(block == i) if i != j else np.arange(len(ids))
        found = []
        top = np.zeros(len(ids), np.int64)
        who = np.zeros(len(ids), np.int64)
        for k, row in enumerate(own):
            others = own[k + 1:] if i == j else np.flatnonzero(block == j)
            others = others[labels[others] != labels[row]]
            if not len(others):
                continue
            same = BITS - np.bitwise_count(sketches[others] ^ sketches[row]).sum(axis=1, dtype=np.int64)
            good = same >= least
            others, same = others[good], same[good]
            first = (bands[others] == bands[row]).argmax(axis=1) == band
            others, same = others[first], same[first]
            if not len(others):
                continue
            if not best:
                found.append((np.full(len(others), ids[row]), ids[others], same))
                continue
            better = same > top[others]
            top[others[better]], who[others[better]] = same[better], ids[row]
            k_best = same.argmax()
            if same[k_best] > top[row]:
                top[row], who[row] = same[k_best], ids[others[k_best]]
        if best:
            has = top > 0
            found = [(ids[has], who[has], top[has])]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            done, held = _cut(held)
            if done is not None:
                yield from _run(done)
        if held is not None and held.num_rows:
            yield from _run(held)

    def _heads(batch) -> np.ndarray:
        key, i, j = (batch.column(c).to_numpy() for c in range(3))
        return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])

    def _cut(batch):
        """All groups but the last, which may go on in the next batch."""
        if not batch.num_rows:
            return None, None
        last = int(_heads(batch)[-1])
        return (batch.slice(0, last) if last else None), batch.slice(last)

    def _run(batch) -> Iterator[pa.RecordBatch]:
        heads = _heads(batch)
        i, j, block, ids, labels = (batch.column(c).to_numpy() for c in range(1, 6))
        sketches = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        key, band = batch.column(0).to_numpy(), batch.column(7).to_numpy()
        bands = batch.column(8).flatten().to_numpy().reshape(batch.num_rows, -1)
        found = []
        for a, b in zip(heads, np.r_[heads[1:], batch.num_rows]):
            pairs = group(block[a:b], ids[a:b], labels[a:b], sketches[a:b], bands[a:b], band[a], i[a], j[a])
            found += [(*p, np.full(len(p[0]), key[a])) for p in pairs if len(p[0])]
        if found:
            a, b, same, key = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(same.astype(np.int64)), pa.array(key)],
                                             names=["a", "b", "same", "key"])

    return run


def _candidates(members: DataFrame, labels: DataFrame, sketches: DataFrame, least: int, best: bool) -> DataFrame:
    """(a, b, same, key): pairs of one bucket and different components, by their sketches: best partners, or all."""
    labelled = members.join(labels, "id").select("key", "band", "id", "label")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    mixed = mixed.filter("lo < hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = labelled.join(mixed, "key").join(sketches, "id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id",
                       "label", "sketch", "band", "bands")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return rows.mapInArrow(_compare(least, best), "a bigint, b bigint, same bigint, key bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    size: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``df``."""
    mark = stored()
    texts = df.select(column(key).alias("id"), column(text).cast("string").alias("text"))
    schema = "id bigint, n_shingles bigint, digest binary, bands array<bigint>"
    sketched = store(texts.mapInArrow(_sketch(size), schema), "sketches")

    classes = sketched.filter("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = store(classes.filter("n > 1").select("digest", "rep"), "classes")
    copies = store(sketched.select("id", "digest").join(classes, "digest").select("id", "rep"), "copies")
    alone = sketched.filter("digest is not null and id is not null").join(
        copies.filter("id != rep").select("id"), "id", "left_anti")

    banded = alone.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    members = store(banded.join(buckets, "key").select("key", "band", "id", "least"), "members")
    wanted = store(members.select("id").distinct(), "wanted")
    sets = store(texts.join(wanted, "id").mapInArrow(_sets(size), "id bigint, shingles binary, sketch binary"), "sets")
    short = F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("bands")
    sketches = store(sketched.select("id", short).join(wanted, "id").join(sets.select("id", "sketch"), "id"), "compared")

    least = least_matches(percent)
    first = members.filter("least < id").groupBy("id").agg(F.min("least").alias("b")).select(F.col("id").alias("a"), "b")
    links = _verified(first, sets, percent, "star")
    labels = store(joined(wanted.select("id", F.col("id").alias("label")), links), "labels")
    while True:
        close = store(_candidates(members, labels, sketches, least, True), "close")
        asked = close.groupBy("a").agg(F.max(F.struct("same", "b")).alias("top")).select("a", "top.b")
        asked = store(_ordered(asked), "asked")
        members = store(members.join(close.select("key").distinct(), "key"), "members")  # no pair is left in the others
        more = _verified(asked, sets, percent, "best")
        found, tried = more.count(), asked.count()
        if found:
            links = links.unionByName(more)
            labels = store(joined(labels, more), "labels")
        if 4 * found <= tried:  # most of what is left is below the threshold
            break
    rest = _ordered(_candidates(members, labels, sketches, least, False))
    links = links.unionByName(_verified(rest, sets, percent, "rest"))
    labels = store(components(links), "labels")

    out = sketched.select("id", "n_shingles").join(copies.dropDuplicates(["id"]), "id", "left")
    out = out.withColumn("rep", F.coalesce("rep", "id")).join(labels, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("label", "rep")
    out = out.select("id", "n_shingles", component.alias("component_id"),
                     F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    return finish(out, "groups", mark)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose document represents its group, with their own columns."""
    found = near_duplicates(df, key, text).filter(~F.col("kept")).select(F.col("id").alias("__gone")).distinct()
    return df.join(found, column(key) == F.col("__gone"), "left_anti")


def query(spark, folder: str) -> DataFrame:
    """Groups of near-duplicates among all documents."""
    found = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
c(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.reach FROM c JOIN e ON e.a = c.doc_id
  WHERE c.reach < e.b)
SELECT c.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reach) AS component_id, min(reach) = c.doc_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id
"""
