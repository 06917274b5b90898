"""Ranks, cuts and dense indexes that never need one task to hold a whole group.

* ``top_k``          k best rows per group; Spark prunes to k rows per map task before the shuffle.
* ``rank_within``    exact rank in a group of any size: a group above ``task_rows`` is cut into
                     buckets along its order, each ranked alone and shifted by the rows before it.
* ``nth_key``        key of the n-th row in a global order in two looks at the rows, of which only a
                     narrow bracket is moved.
* ``bucketed_sum``   running total in a group of any size, bucket by bucket.
* ``dense_index``    0..n-1 numbering by a global order, from one range-partitioned sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.session import cut

TASK_ROWS = 1_000_000
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count has been checked; above the bound Spark picks the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def bucketed_rank(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column],
                  split: Column, rank: str) -> DataFrame:
    """1-based rank in ``group`` where ``bucket`` rises along ``order``.

    ``split`` marks the rows of groups that have more than one bucket; only those are counted
    for the shift, so ordinary groups cost one shuffle and no second pass.
    """
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shift = (df.filter(split).groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_rows"))
             .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
             .select(*group, bucket, "_before"))
    w = Window.partitionBy(*group, bucket).orderBy(*order)
    return (df.withColumn(rank, F.row_number().over(w))
            .join(shift, [*group, bucket], "left")
            .withColumn(rank, (F.col(rank) + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint"))
            .drop("_before"))


def bucketed_sum(df: DataFrame, group: Sequence[str], bucket: str, order: str, value: Column, split: Column, large: bool,
                 out: str) -> DataFrame:
    """Running total of ``value`` by ``order`` in ``group``, where ``bucket`` rises along ``order``.

    As with ``bucketed_rank``, only the rows that ``split`` marks are summed for the shift; ``large`` tells whether it marks any.
    """
    w = Window.partitionBy(*group, bucket).orderBy(order)
    valued = df.withColumn("_value", value)
    running = valued.withColumn(out, F.sum("_value").over(w)).drop("_value")
    if not large:
        return running
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shift = (valued.filter(split).groupBy(*group, bucket).agg(F.sum("_value").alias("_total"))
             .withColumn("_before", F.sum("_total").over(before)).select(*group, bucket, "_before"))
    return (running.join(shift, [*group, bucket], "left")
            .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_before"))


def rank_within(df: DataFrame, group: Sequence[str], key: str, order: Sequence[Column] | None = None,
                rank: str = "rn", size: str = "n", task_rows: int | None = None, largest: int | None = None) -> DataFrame:
    """Rank and group size by ``order`` (default: ``key``), for groups of any size.

    ``key`` is a hex column, spread evenly and rising with ``order``: its leading digits cut a
    large group into buckets of about ``task_rows`` rows. At most rows/task_rows groups are large,
    which bounds the broadcast table of large groups. Group columns must not be null. Without a large group
    (``largest``, where it is known, says so) the rows move once, by group alone.
    """
    limit = task_rows or TASK_ROWS
    order = list(order) if order is not None else [F.col(key)]
    group = list(group)
    if not group:
        df = df.withColumn("_all", F.lit(0))
    by = group or ["_all"]
    if largest is None or largest > limit:
        large = cut(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > limit)
                    .withColumn("_digits", F.ceil(F.log(F.col("_size") / F.lit(float(limit))) / F.log(F.lit(16.0))).cast("int")))
    if (largest is not None and largest <= limit) or large.isEmpty():
        w = Window.partitionBy(*by)
        return (df.withColumn(rank, F.row_number().over(w.orderBy(*order)).cast("bigint"))
                .withColumn(size, F.count(F.lit(1)).over(w)).drop("_all"))
    marked = (df.join(F.broadcast(large), by, "left")
              .withColumn("_bucket", F.when(F.col("_size").isNotNull(),
                                            F.substring(F.col(key), F.lit(1), F.greatest(F.col("_digits"), F.lit(1))))
                          .otherwise(F.lit(""))))
    ranked = bucketed_rank(marked, by, "_bucket", order, F.col("_size").isNotNull(), rank)
    own = F.count(F.lit(1)).over(Window.partitionBy(*by, "_bucket"))
    return (ranked.withColumn(size, F.coalesce(F.col("_size"), own))
            .drop("_bucket", "_size", "_digits", "_all"))


SKETCH = 10_000  # relative accuracy of the sketch that brackets a position


def nth_key(df: DataFrame, x: Column, key: Sequence[Column], share: float, position: Callable[[int], int],
            sketch: int = SKETCH) -> tuple[int, tuple | None]:
    """(rows, key of the row at ``position(rows)``) in the order ``key``, counted from 1; no key where the position is 0 or less.

    ``x`` is a number that never falls along the order, such as the time; ``share`` says about where the position lies. Two looks
    at the rows: one for their count and a quantile sketch of ``x`` (mergeable, of bounded size), whose error gives a bracket
    around the position; one that counts the rows below the bracket and stores the keys inside it, about 4 / ``sketch`` of all
    and the ties at its ends. Those alone are sorted, over all tasks. Only a count, two numbers and one key reach the driver.
    """
    low, high = share - 2 / sketch, share + 2 / sketch
    points = F.percentile_approx("x", [min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)], sketch)
    keyed = df.select(x.cast("double").alias("x"), *[k.alias(f"k{i}") for i, k in enumerate(key)])
    names = keyed.columns[1:]
    rows, ends = keyed.agg(F.count(F.lit(1)), points).first()
    n = position(rows)
    if n <= 0 or not rows:
        return rows, None
    first = -math.inf if low <= 0 or ends is None else ends[0]
    last = math.inf if high >= 1 or ends is None else ends[1]
    while True:
        value = F.coalesce(F.col("x"), F.lit(-math.inf))  # nulls come first in the order
        side = F.when(value < first, 0).when(value <= last, 1).otherwise(2)
        sided = keyed.withColumn("side", side).select("side", *[F.when(F.col("side") == 1, F.col(c)).alias(c) for c in names])
        # rows outside the bracket fold into one row a task before they are shuffled
        folded = cut(sided.groupBy("side", *names).agg(F.count(F.lit(1)).alias("c")))
        below, upto = folded.agg(*[F.coalesce(F.sum(F.when(F.col("side") <= i, F.col("c"))), F.lit(0)) for i in (0, 1)]).first()
        if below < n <= upto:
            break
        first, last = (-math.inf, last) if n <= below else (first, math.inf)  # the sketch was off: look at all on that side
    ranked = dense_index(folded.filter(F.col("side") == 1).withColumn("w", F.col("c").cast("double")),
                         [F.col(c) for c in names], "_", weight="w")
    hit = (F.col("running") >= n - below) & (F.col("running") - F.col("w") < n - below)
    return rows, tuple(ranked.filter(hit).select(*names).first())


def not_after(key: Sequence[Column], boundary: tuple | None) -> Column:
    """True for rows at or before the boundary key, comparing left to right."""
    if boundary is None:
        return F.lit(False)
    pairs = list(zip(key, [F.lit(v) for v in boundary]))
    last, bound = pairs[-1]
    return reduce(lambda rest, kv: (kv[0] < kv[1]) | ((kv[0] == kv[1]) & rest),
                  reversed(pairs[:-1]), last <= bound)


def dense_index(df: DataFrame, order: Sequence[Column], index: str = "idx", weight: str | None = None) -> DataFrame:
    """Number the rows 0..n-1 by ``order`` (must be unique); with ``weight`` also its running total.

    A global sort range-partitions the rows; the position inside a partition comes free from
    ``monotonically_increasing_id`` and each partition is shifted by the rows before it. The sort
    is materialised first, since drawing the range bounds twice could number rows twice. The
    joined shift table has one row per partition.
    """
    local = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    local = (local.withColumn("_part", F.shiftright("_mid", 33))
             .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    totals = [F.count(F.lit(1)).alias("_rows")]
    if weight:
        totals.append(F.sum(weight).alias("_weight"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = local.groupBy("_part").agg(*totals).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
        *([F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_wshift")] if weight else []))
    out = local.join(F.broadcast(shift), "_part").withColumn(index, F.col("_shift") + F.col("_local"))
    if weight:
        running = F.sum(weight).over(Window.partitionBy("_part").orderBy("_local"))
        out = out.withColumn("running", F.col("_wshift") + running)
    return out.drop("_part", "_mid", "_local", "_shift", "_wshift")
