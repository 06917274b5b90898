"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Equal vectors form a class; one of each class is compared. Centres are fitted on about ``SAMPLE`` vectors, chosen by
their own hash, all where there are fewer; every vector is assigned. A vector is at home in the cell of its nearest centre and also visits every cell whose border
(the plane between the two centres) lies within ``MARGIN``, half the distance of two unit vectors of cosine 0.9. A pair with
homes of its own each crosses the border between them, so at least one of it is that near and meets the other in its home: no
pair is missed, whatever the centres. Products are taken in double precision, tile by tile, between blocks of about ``BLOCK``
vectors; a block emits a count per vector and one link per vector
that joins it to others of its block, never its pairs. A pair is counted in one cell only: that where one of it is at home,
and the smaller one if both visit each other.

Cells are large, since a vector of many dimensions without clusters visits most of them: what is shipped grows with the number
of cells, and the products are fast.

Vectors of each length are compared among themselves; a length of ``CELL`` vectors or fewer is one cell. Numbers keep the
precision of their column.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite number links with nothing; repeated rows are vectors of their own that are
linked; a row without an id links with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import Shared, column, finish, store, stored
from tastegrid.llm.graph import components

THRESHOLD = 0.9
SAMPLE = 20_000
CELL = 8_192            # vectors to a cell, on the average, as long as there are enough centres
MOST_CELLS = 1_024
MARGIN = math.sqrt(2 - 2 * THRESHOLD) / 2 + 1e-4  # exact, and a little for rounding
BLOCK = 16_384
TILE = 1_024          # vectors on a side of one product
ROUNDS = 8


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    values = values.astype(np.float64)
    top = np.abs(values).max(axis=1, keepdims=True)  # lengths of very large or small numbers neither overflow nor vanish
    values = values / top
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def spherical_centres(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """k unit centres of unit vectors; an empty cell takes the vector that fits its own centre worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        fit = x @ centres.T
        home = fit.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        worst = iter(np.argsort(fit[np.arange(len(x)), home], kind="stable"))
        for empty in np.flatnonzero(size < 1e-9):
            sums[empty] = x[next(worst)]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def visits(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home cells, and a table of the cells that each vector visits (its home among them)."""
    fit = x @ centres.T
    home = fit.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))
    distance = (fit[np.arange(len(x)), home][:, None] - fit) / apart[home]
    inside = distance <= MARGIN
    inside[np.arange(len(x)), home] = True
    return home, inside


def _by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(lengths).tolist():
        yield d, np.flatnonzero(lengths == d)


def _vectors(kind: str):
    """(id, d, vector) of usable vectors, as bytes of numbers of this kind; nulls are known to be absent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at in _by_length(pc.list_value_length(batch.column(1)).to_numpy()):
                some = batch.take(pa.array(at))
                table = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
                good = np.isfinite(table).all(axis=1) & table.any(axis=1)
                rows = [row.tobytes() for row in table[good] + table.dtype.type(0)]  # no negative zeros
                yield pa.RecordBatch.from_arrays([some.column(0).filter(pa.array(good)), pa.array([d] * len(rows), pa.int32()),
                                                  pa.array(rows, pa.binary())], names=["id", "d", "vector"])
    return run


def _matrix(column_: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column_.to_pylist()), kind).reshape(len(column_), -1)


def _assign(centres: Shared, kind: str):
    """Cells per length of vectors; a length without centres is one cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, own in _by_length(whole.column(1).to_numpy()):
                batch = whole.take(pa.array(own))
                if d in centres.value:
                    home, inside = visits(unit(_matrix(batch.column(3), kind)), centres.value[d])
                else:
                    home, inside = np.zeros(len(own), np.int64), np.ones((len(own), 1), bool)
                rows, cells = np.nonzero(inside)
                bits = pa.array([b.tobytes() for b in np.packbits(inside, axis=1)], pa.binary())
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(at), pa.array(cells.astype(np.int32)), pa.array(home[rows].astype(np.int32)),
                     batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), bits.take(at)],
                    names=["d", "cell", "home", "id", "times", "vector", "visits"])
    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component in a graph of n nodes with links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _products(kind: str):
    """Counts (id, n, null) and links (id, null, other) of runs of rows with one (d, cell, i, j).

    Rows are (d, cell, i, j, part, home, id, times, vector, visits), sorted by the first four.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            heads = _heads(held)
            for a, b in zip(heads[:-1], heads[1:]):
                yield from _block(held.slice(int(a), int(b - a)), kind)
            held = held.slice(int(heads[-1])) if len(heads) else None
        if held is not None and held.num_rows:
            yield from _block(held, kind)
    return run


def _heads(batch: pa.RecordBatch) -> np.ndarray:
    if not batch.num_rows:
        return np.empty(0, int)
    keys = np.stack([batch.column(c).to_numpy() for c in range(4)])
    return np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])


def _block(batch: pa.RecordBatch, kind: str) -> Iterator[pa.RecordBatch]:
    cell, i, j = (batch.column(c)[0].as_py() for c in range(1, 4))
    part, home, ids, times = (batch.column(c).to_numpy() for c in range(4, 8))
    left = np.flatnonzero(part == i)
    right = left if i == j else np.flatnonzero(part == j)
    if not len(left) or not len(right):
        return
    x = _matrix(batch.column(8), kind)
    bits = None
    if i != j:
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint8).reshape(len(ids), -1), axis=1)
    counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for l in range(0, len(left), TILE):
        mine = left[l:l + TILE]
        rows = unit(x[mine])
        for r in range(l if i == j else 0, len(right), TILE):
            theirs = right[r:r + TILE]
            met = np.argwhere(rows @ unit(x[theirs]).T >= THRESHOLD)
            a, b = mine[met[:, 0]], theirs[met[:, 1]]
            if i == j:
                a, b = a[a < b], b[a < b]
            else:  # a is at home here; if b is a visitor whose home a visits as well, the smaller cell counts the pair
                ours = (home[b] == cell) | (bits[a, home[b]] == 0) | (home[b] > cell)
                a, b = a[ours], b[ours]
            if len(a):
                np.add.at(counts, a, times[b])
                np.add.at(counts, b, times[a])
                root = _roots(len(ids), np.r_[a, np.arange(len(ids))], np.r_[b, root])
    if not counts.any():
        return
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(counts[seen]),
                                      pa.nulls(len(seen), pa.int64())], names=["id", "n", "other"])
    joined = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[joined]), pa.nulls(len(joined), pa.int64()),
                                      pa.array(ids[root[joined]])], names=["id", "n", "other"])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``df``."""
    spark, mark = df.sparkSession, stored()
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    rows = df.select(column(key).alias("id"), column(vector).cast("array<double>").alias("v"))
    whole = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull())
    usable = rows.filter(whole).mapInArrow(_vectors(kind), "id bigint, d int, vector binary")
    table = store(usable.withColumn("class", F.sha2("vector", 256)), "vectors")
    classes = table.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    one = table.select("class", "d", "vector", "id").join(classes, "class").filter("id = rep").dropDuplicates(["class"])
    one = store(one.select("rep", "d", "times", "vector"), "classes")

    found = one.groupBy("d").count().filter(F.col("count") > CELL).collect()  # total / CELL rows at most
    if one.isEmpty():
        links = store(table.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), "links")
        counts = table.select("id", F.lit(0).cast("bigint").alias("n")).limit(0)
    else:
        fitted = {}
        place = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / float(1 << 30)
        for d, total in found:
            picked = one.filter((F.col("d") == d) & (place < SAMPLE / total)).select("vector").collect()
            picked = sorted(bytes(r["vector"]) for r in picked)
            if len(picked) > 1:
                x = unit(np.stack([np.frombuffer(r, kind) for r in picked]))
                fitted[d] = spherical_centres(x, min(MOST_CELLS, math.ceil(total / CELL), len(x)))
        assigned = one.mapInArrow(  # found twice, as storing it takes a copy of the vectors for each visit
            _assign(Shared(spark, fitted), kind),
            "d int, cell int, home int, id bigint, times bigint, vector binary, visits binary")
        at_home = F.col("home") == F.col("cell")
        sizes = assigned.groupBy("d", "cell").agg(
            F.ceil(F.sum(at_home.cast("int")) / BLOCK).cast("int").alias("own"),
            F.ceil(F.sum((~at_home).cast("int")) / BLOCK).cast("int").alias("guests"))
        placed = assigned.join(sizes, ["d", "cell"])  # one row per cell and length
        hashed = F.pmod(F.xxhash64("id"), F.when(at_home, F.col("own")).otherwise(F.greatest("guests", F.lit(1))))
        placed = placed.withColumn("part", (hashed + F.when(at_home, 0).otherwise(F.col("own"))).cast("int"))
        last = F.when(at_home, F.col("own") + F.col("guests")).otherwise(F.col("own")) - 1
        placed = placed.filter("own > 0").withColumn("with", F.explode(F.sequence(F.lit(0), last)))
        placed = placed.select("d", "cell", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part",
                               "home", "id", "times", "vector", "visits")
        placed = placed.repartition("d", "cell", "i", "j").sortWithinPartitions("d", "cell", "i", "j", "id")
        found = store(placed.mapInArrow(_products(kind), "id bigint, n bigint, other bigint"), "products")
        counts = found.filter("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
        links = found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))

    labels = components(links)
    member = table.select("id", "class").join(classes, "class").select("id", "rep", "times")
    member = member.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.select("id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"),
                           F.coalesce("label", "rep").alias("component_id")).dropDuplicates(["id", "n_links", "component_id"])
    out = rows.select("id").join(member, "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                     F.coalesce("component_id", "id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return finish(out, "groups", mark)


def query(spark, folder: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(vec_id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, c.reach FROM c JOIN l ON l.a = c.vec_id
  WHERE c.reach < l.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(reach) AS component_id, min(reach) = c.vec_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id GROUP BY c.vec_id
"""
