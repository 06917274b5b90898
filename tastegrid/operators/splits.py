"""Train / validation / test labelling of interactions.

Every strategy returns the rows with a ``split`` column instead of separate tables, so a split is
one pass plus the counts it needs. Rows need a unique ``row_id``: interactions may repeat, and the
seeded hash of ``row_id`` is what makes a draw random yet reproducible. Group sizes are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions.hashing import hash_key, hex_number
from tastegrid.operators.ranking import TASK_ROWS, not_after, nth_key, rank_within, small, top_k
from tastegrid.session import cut, stored

SEED = 42
WARM_ROWS = 3  # rows of the most active warm user, from which on warm rows are split per user
_BIG = "decimal(19,0)"


def _check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1.0) > 1e-8:
        raise ValueError("the split ratios must sum to 1")


def _check_column(df: DataFrame, column: str | None, what: str) -> None:
    if not column or column not in df.columns:
        raise ValueError(f"{what} column '{column}' not found")


def _cut_at(df: DataFrame, x: Column, key: Sequence[Column], share: float, position: Callable[[int], int],
            first: str, second: str) -> DataFrame:
    """Label the first ``position(rows)`` rows of the order ``key``, about ``share`` of them, without moving any row."""
    _, boundary = nth_key(df, x, key, share, position)
    return df.withColumn("split", F.when(not_after(key, boundary), F.lit(first)).otherwise(F.lit(second)))


def largest_remainder(strata: DataFrame, count: str, total: int, out: str) -> DataFrame:
    """Share ``total`` over the strata in proportion to ``count``; left-over units go to the largest
    remainders, ties by stratum. Needs the columns ``stratum`` and ``count``; ``strata`` should be
    materialised, as it is read for its sums before it is read for the result."""
    whole = strata.agg(F.sum(count)).first()[0] or 0
    if not whole:
        return strata.withColumn(out, F.lit(0).cast("bigint"))
    units = F.col(count).cast(_BIG) * F.lit(total).cast(_BIG)
    parts = (strata.withColumn("_floor", F.floor(units / F.lit(whole).cast(_BIG)).cast("bigint"))
             .withColumn("_rem", (units % F.lit(whole).cast(_BIG)).cast("bigint")))
    spare = total - parts.agg(F.sum("_floor")).first()[0]
    # Hex key rising as the remainder falls, so that even a very long strata list ranks in parts.
    gap = (F.lit(1.0) - F.col("_rem") / F.lit(float(whole))) * F.lit(float((1 << 40) - 1))
    parts = parts.withColumn("_key", F.lpad(F.hex(F.floor(gap).cast("bigint")), 10, "0"))
    ranked = rank_within(parts, [], "_key", [F.col("_rem").desc(), F.col("stratum")], "_place", "_strata")
    return (ranked.withColumn(out, F.col("_floor") + F.when(F.col("_place") <= spare, 1).otherwise(0))
            .select(*strata.columns, out))


def _stratified_two_way(df: DataFrame, seed: int, head_total: Callable[[int], int],
                        tail_share: float | None, strata_count: int) -> DataFrame:
    """Rank rows inside ``stratum`` and attach quotas.

    ``head_total(n)`` rows go to the front slice overall; of these, ``tail_share`` (rounded up) is
    what remains after the middle slice. Adds n_front and n_middle per row's stratum. The strata
    table is small and materialised once; its totals are single numbers.
    """
    sizes = cut(df.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows")))
    front = head_total(sizes.agg(F.sum("rows")).first()[0] or 0)
    quotas = largest_remainder(sizes, "rows", front, "n_front")
    if tail_share is None:
        quotas = quotas.withColumn("n_middle", F.col("n_front"))
    else:
        quotas = largest_remainder(cut(quotas), "n_front", front - math.ceil(front * tail_share), "n_middle")
    keyed = df.withColumn("_key", hash_key("row_id", seed=seed))
    ranked = rank_within(keyed, ["stratum"], "_key", [F.col("_key"), F.col("row_id")])
    quotas = small(cut(quotas.select("stratum", "n_front", "n_middle")), strata_count)
    return ranked.join(quotas, "stratum").drop("_key")


def _stratum(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("stratum", F.coalesce(F.col(column).cast("string"), F.lit("")))


def _strata_shape(df: DataFrame) -> tuple[int, int]:
    """Rows of the smallest stratum (0 when there is none) and the number of strata."""
    sizes = df.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"))
    row = sizes.agg(F.min("rows").alias("least"), F.count(F.lit(1)).alias("strata")).collect()[0]
    return row["least"] or 0, row["strata"]


def column_stratified_split(df: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.15,
                            test_ratio: float = 0.15, stratify_by: str | None = None, seed: int = SEED) -> DataFrame:
    """Random three-way split keeping the share of every stratum; train gets ceil(ratio * n) rows."""
    _check_column(df, stratify_by, "stratification")
    _check_ratios(train_ratio, val_ratio, test_ratio)
    strata = _stratum(df, stratify_by)
    smallest, count = _strata_shape(strata)
    if smallest < 2:
        raise ValueError("the least populated stratum has fewer than 2 rows")
    quoted = _stratified_two_way(strata, seed, lambda n: n - math.ceil(n * train_ratio),
                                 test_ratio / (val_ratio + test_ratio), count)
    label = (F.when(F.col("rn") <= F.col("n_middle"), "val")
             .when(F.col("rn") <= F.col("n_front"), "test").otherwise("train"))
    return quoted.withColumn("split", label).drop("rn", "n", "n_front", "n_middle", "stratum")


def _time_order(df: DataFrame, timestamp: str, seed: int) -> tuple[Column, list[Column]]:
    """A number that rises with time, and the key of the order (time, seeded hash)."""
    t = F.col(timestamp)
    kind = df.schema[timestamp].dataType.simpleString()
    x = t if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else F.unix_micros(t.cast("timestamp"))
    return x, [t, hash_key("row_id", seed=seed)]


def temporal_split(df: DataFrame, timestamp: str = "timestamp", train_ratio: float = 0.8,
                   seed: int = SEED) -> DataFrame:
    """The first int(n * ratio) rows in time are train, the rest val; equal times in hash order."""
    _check_column(df, timestamp, "timestamp")
    x, key = _time_order(df, timestamp, seed)
    return _cut_at(df, x, key, train_ratio, lambda n: int(n * train_ratio), "train", "val")


def stratified_temporal_split(df: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.15,
                              test_ratio: float = 0.15, timestamp: str = "timestamp",
                              stratify_by: str | None = None, seed: int = SEED, items: DataFrame | None = None) -> DataFrame:
    """Oldest rows are train; later rows of train users are shared between val and test by stratum.

    The rows are stored once, as they are read several times. With ``items`` the stratify column is taken from that table, for the
    later rows alone, and isn't returned.
    """
    _check_column(df, timestamp, "timestamp")
    if stratify_by:
        _check_column(df if items is None else items, stratify_by, "stratification")
    df = stored(df)
    x, key = _time_order(df, timestamp, seed)
    halves = _cut_at(df, x, key, train_ratio, lambda n: int(n * train_ratio), "train", "later")
    train = halves.filter(F.col("split") == "train")
    later = halves.filter(F.col("split") == "later").join(train.select("user_id").distinct(), "user_id", "left_semi")
    if stratify_by and items is not None:
        later = later.drop(stratify_by).join(items.select("item_id", stratify_by), "item_id", "left")
    strata = _stratum(later, stratify_by) if stratify_by else later.withColumn("stratum", F.lit(""))
    strata = stored(strata.select("stratum", *train.columns))
    smallest, count = _strata_shape(strata)
    if smallest == 0:
        raise ValueError("no later interactions are left for users of the training period")
    if smallest < 2:
        strata, count = strata.withColumn("stratum", F.lit("")), 1
    share = test_ratio / (val_ratio + test_ratio)
    quoted = _stratified_two_way(strata, seed, lambda n: n - math.ceil(n * share), None, count)
    labelled = quoted.withColumn("split", F.when(F.col("rn") <= F.col("n_front"), "val").otherwise("test"))
    return train.unionByName(labelled.select(*train.columns))


def _entity_split(df: DataFrame, column: str, train_ratio: float, minimum: int, seed: int) -> DataFrame:
    kept = (df.groupBy(column).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= minimum)
            .select(column, hash_key(column, seed=seed).alias("_key")))
    if kept.isEmpty():
        raise ValueError(f"no {column} has at least {minimum} interactions")
    ranked = rank_within(kept, [], "_key", [F.col("_key"), F.col(column)])
    label = F.when(F.col("rn") <= F.floor(F.col("n") * F.lit(train_ratio)), "train").otherwise("val")
    return df.join(ranked.select(column, label.alias("split")), column)


def user_based_split(df: DataFrame, train_ratio: float = 0.8, min_interactions: int = 5, seed: int = SEED) -> DataFrame:
    """Disjoint users: floor(ratio * users) random users are train. Users with few rows are left out."""
    return _entity_split(df, "user_id", train_ratio, min_interactions, seed)


def item_based_split(df: DataFrame, train_ratio: float = 0.8, min_interactions: int = 3, seed: int = SEED) -> DataFrame:
    return _entity_split(df, "item_id", train_ratio, min_interactions, seed)


def simple_random_split(df: DataFrame, train_ratio: float = 0.8, seed: int = SEED) -> DataFrame:
    """Exactly round(ratio * n) random rows are train."""
    key = hash_key("row_id", seed=seed)
    return _cut_at(df, hex_number(key), [key], train_ratio, lambda n: round(n * train_ratio), "train", "val")


def _per_user_label(minimum: int, train_ratio: float) -> Column:
    n_train = F.least(F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(train_ratio))), F.col("n") - 1)
    return F.when((F.col("n") < minimum) | (F.col("rn") <= n_train), "train").otherwise("val")


def per_user_split(df: DataFrame, train_ratio: float = 0.8, min_interactions: int = 3, seed: int = SEED) -> DataFrame:
    """Random share of each user's rows; users with few rows are wholly train."""
    qualified = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_interactions)
    if qualified.isEmpty():
        return simple_random_split(df, train_ratio, seed)
    keyed = df.withColumn("_key", hash_key("row_id", seed=seed))
    ranked = rank_within(keyed, ["user_id"], "_key", [F.col("_key"), F.col("row_id")])
    return ranked.withColumn("split", _per_user_label(min_interactions, train_ratio)).drop("_key", "rn", "n")


def leave_one_out_split(df: DataFrame, min_interactions: int = 3, timestamp: str = "timestamp") -> DataFrame:
    """Latest row per user is test, the one before val, the rest train.

    Only the two latest rows of each user are ranked (pruned before the shuffle); the labels come
    back by ``row_id``, which spreads evenly however active a user is. Where no user is too active
    for a task, the rows are dealt out by user instead and move once.
    """
    _check_column(df, timestamp, "timestamp")
    counts = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c"))
    order = [F.col(timestamp).desc(), F.col("item_id").desc(), F.col("row_id").desc()]
    if (counts.agg(F.max("_c")).first()[0] or 0) <= TASK_ROWS:
        mine = Window.partitionBy("user_id")
        held = F.col("user_id").isNotNull() & (F.count(F.lit(1)).over(mine) >= min_interactions)
        place = F.when(held, F.row_number().over(mine.orderBy(*order)))
        return df.withColumn("_place", place).withColumn("split", F.when(F.col("_place") == 1, "test").when(
            F.col("_place") == 2, "val").otherwise("train")).drop("_place")
    active = counts.filter(F.col("_c") >= min_interactions).select("user_id")
    last = top_k(df.select("user_id", "item_id", timestamp, "row_id"), ["user_id"], order, 2)
    held = (last.join(active, "user_id", "left_semi")
            .select("row_id", F.when(F.col("rank") == 1, "test").otherwise("val").alias("split")))
    return df.join(held, "row_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def cold_start_split(df: DataFrame, cold_user_ratio: float = 0.1, cold_item_ratio: float = 0.1,
                     train_ratio: float = 0.8, seed: int = SEED) -> DataFrame:
    """Four user/item warmth quadrants; the warm-warm one is split per user.

    The quantiles run over the distinct values of a count, of which n rows can have at most
    about sqrt(2 n).
    """

    df = stored(df)  # read for the counts, for the warm users and for the labels

    def cold(column: str, ratio: float, flag: str) -> tuple[DataFrame, int]:
        counts = stored(df.groupBy(column).agg(F.count(F.lit(1)).alias("_c")))
        threshold, largest = counts.agg(F.percentile("_c", F.lit(ratio)), F.max("_c")).first()
        found = counts.filter((F.col("_c") <= F.lit(threshold).cast("double")) & F.col(column).isNotNull())
        return small(found.select(column, F.lit(True).alias(flag)), found.count()), largest

    (users, largest), (items, _) = cold("user_id", cold_user_ratio, "cold_user"), cold("item_id", cold_item_ratio, "cold_item")
    known = df.join(items, "item_id", "left")
    warm_rows = known.filter(F.col("cold_item").isNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("_c"))
    most = warm_rows.join(users, "user_id", "left_anti").agg(F.max("_c")).first()[0] or 0
    marked = (known.join(users, "user_id", "left")
              .withColumn("_quadrant", F.when(F.col("cold_user") & F.col("cold_item"), "val_cold_both")
                          .when(F.col("cold_user"), "val_cold_user")
                          .when(F.col("cold_item"), "val_cold_item").otherwise("warm"))
              .select(*df.columns, "_quadrant"))
    if most >= WARM_ROWS:
        # all in one pass: a user's warm rows are ranked beside the others, where the join with the cold users dealt them
        keyed = marked.withColumn("_warm", F.col("_quadrant") == "warm").withColumn("_key", hash_key("row_id", seed=seed))
        ranked = rank_within(keyed, ["user_id", "_warm"], "_key", [F.col("_key"), F.col("row_id")], largest=largest)
        label = _per_user_label(WARM_ROWS, train_ratio)
        warm = F.when(label == "val", "val_warm").otherwise("train")
        return ranked.withColumn("split", F.when(F.col("_warm"), warm).otherwise(F.col("_quadrant"))).select(*df.columns, "split")
    rest = marked.filter(F.col("_quadrant") != "warm").withColumn("split", F.col("_quadrant"))
    inner = simple_random_split(marked.filter(F.col("_quadrant") == "warm").drop("_quadrant") if most else df, train_ratio, seed)
    inner = inner.withColumn("split", F.when(F.col("split") == "val", "val_warm").otherwise(F.col("split")))
    return inner.unionByName(rest.select(*inner.columns))


def split_statistics(df: DataFrame) -> DataFrame:
    """One row: rows, distinct users and items per split, and how many are shared with train.

    Works from one flag row per user and per item instead of separate distinct counts.
    """
    parts = ("train", "val", "test")

    def flags(column: str) -> DataFrame:
        return df.groupBy(column).agg(*[F.max((F.col("split") == p).cast("int")).alias(p) for p in parts])

    def entity(column: str, name: str) -> DataFrame:
        per = flags(column)
        both = {p: F.sum(F.col("train") * F.col(p)) for p in ("val", "test")}
        counts = [F.coalesce(F.sum(p), F.lit(0)).alias(f"{p}_{name}s") for p in parts]
        shared = [F.coalesce(both[p], F.lit(0)).alias(f"{name}_overlap_{p}") for p in both]
        ratios = [F.coalesce(F.when(F.sum(p) > 0, both[p] / F.sum(p)), F.lit(0.0)).alias(f"{name}_overlap_ratio_{p}")
                  for p in both]
        return per.agg(*counts, *shared, *ratios)

    rows = df.agg(*[F.count_if(F.col("split") == p).alias(f"{p}_rows") for p in parts])
    return _side_by_side(rows, entity("user_id", "user"), entity("item_id", "item"))


def _side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables next to each other, by scalar lookups."""
    out = first
    for i, other in enumerate(others):
        packed = other.select(F.struct(*other.columns)).scalar()
        out = out.withColumn(f"_p{i}", packed).select(*out.columns, f"_p{i}.*")
    return out


def leakage_check(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """One row: train end, val/test start, whether time order holds, and users unseen in train."""
    times = df.agg(
        F.max(F.when(F.col("split") == "train", F.col(timestamp))).alias("train_end"),
        F.min(F.when(F.col("split") != "train", F.col(timestamp))).alias("later_start"))
    per_user = df.groupBy("user_id").agg(F.max((F.col("split") == "train").cast("int")).alias("t"))
    unseen = per_user.agg(F.count_if(F.col("t") == 0).cast("bigint").alias("users_without_train"))
    both = _side_by_side(times, unseen)
    return both.withColumn("ordered", F.col("train_end") <= F.col("later_start"))


def time_edges(df: DataFrame, bins: int = 10, timestamp: str = "timestamp") -> DataFrame:
    """One row with the array of distinct inner quantile edges of the time column (micros, linear).

    Equal instants are counted first; running counts are built day by day, minute by minute and
    instant by instant, so each window stays within a bounded number of entries.
    """
    instants = (df.groupBy(F.unix_micros(F.col(timestamp).cast("timestamp")).alias("us"))
                .agg(F.count(F.lit(1)).alias("c"))
                .withColumn("minute", F.floor(F.col("us") / 60_000_000).cast("bigint"))
                .withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("bigint")))

    def running(table: DataFrame, within: str | None, by: str, out: str) -> DataFrame:
        w = (Window.partitionBy(within) if within else Window).orderBy(by)
        return table.withColumn(out, F.sum("c").over(w) - F.col("c"))

    minutes = instants.groupBy("day", "minute").agg(F.sum("c").alias("c"))
    days = running(minutes.groupBy("day").agg(F.sum("c").alias("c")), None, "day", "before_day").drop("c")
    minutes = running(minutes, "day", "minute", "before_minute").drop("c")
    placed = (running(instants, "minute", "us", "before_us")
              .join(minutes.drop("day"), "minute").join(days, "day")
              .withColumn("lo", F.col("before_day") + F.col("before_minute") + F.col("before_us"))
              .withColumn("hi", F.col("lo") + F.col("c") - 1))
    n = F.lit(df.count())
    edges = []
    for i in range(1, bins):
        position = (n - 1) * F.lit(i / bins)
        at = lambda p: F.min(F.when(F.col("hi") >= p, F.col("us")))
        low, high = at(F.floor(position)), at(F.ceil(position))
        edges.append(low + (high - low) * (position - F.floor(position)))
    return placed.agg(F.array_distinct(F.array(*edges)).alias("edges"))


def training_subsets(df: DataFrame, fractions: Sequence[float] = (0.5, 0.4, 0.25), bins: int = 10,
                     timestamp: str = "timestamp", seed: int = SEED) -> DataFrame:
    """Nested subsets stratified by time: column ``level`` is the number of subsets a row is in.

    Each fraction is taken of the subset before it. One random order per bin serves all levels,
    since the front of a random order is itself a random draw.
    """
    edges = time_edges(df, bins, timestamp).first()["edges"]
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    # one comparison per edge: grouping by an expression with a lambda fails in Spark once the rows are in several partitions
    passed = sum((F.coalesce((F.lit(e) < micros).cast("int"), F.lit(0)) for e in edges), F.lit(0))
    binned = df.withColumn("stratum", F.lpad(passed.cast("string"), 3, "0"))
    quotas = cut(binned.groupBy("stratum").agg(F.count(F.lit(1)).alias("q0")))
    size = quotas.agg(F.sum("q0")).first()[0] or 0
    for i, fraction in enumerate(fractions):
        # the kept slice is rounded up overall; the other slice is shared out and subtracted
        kept = math.ceil(size * fraction)
        quotas = largest_remainder(quotas, f"q{i}", size - kept, "_left")
        quotas = cut(quotas.withColumn(f"q{i + 1}", F.col(f"q{i}") - F.col("_left")).drop("_left"))
        size = kept
    keyed = binned.withColumn("_key", hash_key("row_id", seed=seed))
    ranked = rank_within(keyed, ["stratum"], "_key", [F.col("_key"), F.col("row_id")]).join(small(quotas, bins), "stratum")
    level = sum(((F.col("rn") <= F.col(f"q{i + 1}")).cast("int") for i in range(len(fractions))), F.lit(0))
    return ranked.withColumn("level", level).select(*df.columns, F.col("stratum").alias("time_bin"), "level")


def attach_stratum(interactions: DataFrame, items: DataFrame, column: str) -> tuple[DataFrame, str | None]:
    """Pull the stratify column from the item table; without it the split is not stratified."""
    if column not in items.columns:
        return interactions, None
    return interactions.join(items.select("item_id", column), "item_id", "left"), column


# strategy name -> (function, arguments it takes)
STRATEGIES = {
    "stratified_by_column": (column_stratified_split, {"train_ratio", "val_ratio", "test_ratio", "stratify_by"}),
    "stratified_temporal": (stratified_temporal_split,
                            {"train_ratio", "val_ratio", "test_ratio", "timestamp", "stratify_by"}),
    "user": (user_based_split, {"train_ratio", "min_interactions"}),
    "item": (item_based_split, {"train_ratio", "min_interactions"}),
    "temporal": (temporal_split, {"timestamp", "train_ratio"}),
    "stratified": (per_user_split, {"train_ratio", "min_interactions"}),
    "leave_one_out": (leave_one_out_split, {"min_interactions", "timestamp"}),
    "simple_random": (simple_random_split, {"train_ratio"}),
}


def split(df: DataFrame, strategy: str, **arguments) -> DataFrame:
    """Split by strategy name; arguments a strategy does not know are ignored."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown split strategy: {strategy}")
    function, known = STRATEGIES[strategy]
    return function(df, **{k: v for k, v in arguments.items() if k in known})
