"""Drawing catalog items per user without pairing every user with every item.

Uniform draws walk the catalog in a per-user random order (a keyed permutation of its positions), so the first
m + #excluded steps are enough to find m items: the rows made are linear in the output and the exclusions.

Weighted draws without replacement take the m open items that arrive first, where an item of weight w arrives after an
Exp(1)/w wait of its own for each user. The waits aren't made item by item: items fall into classes by the binary exponent of
their weight, and inside a class the ordered waits at the class's top rate come one after another (each gap is an exponential
over the items left), dealt to the items in the user's permutation. An item of less than the top weight accepts its wait with
its share of the top and else waits on by its own rate, which is the same distribution. So the first steps of every class
hold all early arrivals, whatever the skew of the weights, and how far a user walks changes nothing in what is drawn.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions.hashing import exponential_of, hash_key, hex_number, unit_of
from tastegrid.operators.filtering import item_popularity, user_history
from tastegrid.operators.ranking import TASK_ROWS, bucketed_rank, bucketed_sum, dense_index, small
from tastegrid.session import cut, stored

SEED = 42
_CHUNK = 1024
_PRIME = (1 << 31) - 1


def grid(n: int) -> tuple[int, int]:
    """Rows and columns of a nearly square grid with room for n cells and as few others as possible."""
    q = math.isqrt(max(n, 1) - 1) + 1
    columns = min(range(q, 2 * q + 1), key=lambda s: (-(-n // s) * s, s))
    return -(-max(n, 1) // columns), columns


def scattered(df: DataFrame, rows: Column, columns: Column, out: str) -> DataFrame:
    """``df`` with the place of its ``step`` in the permutation of 0..rows*columns-1 that the keys ``_k1``, ``_k2`` choose.

    A Feistel network of four rounds over (row, column): each coordinate in turn is shifted by a cubic of the other modulo a
    prime. Products stay below 2 ** 63 for any grid of fewer than 2 ** 31 rows and columns. Each round is a projection of its
    own, as its value is used several times in the next; a filter on the place would be written out in the rounds' full
    nesting if it were pushed below them, which the explode of one element prevents.
    """
    p = F.lit(_PRIME)
    df = df.withColumn("_y0", F.floor(F.col("step") / columns).cast("bigint")).withColumn("_y1", F.pmod(F.col("step"), columns))
    for i in range(4):
        key, start = ("_k1", "_k2")[i // 2], 1 + 16 * (i % 2)
        shift, slope = F.pmod(hex_number(F.col(key), start, 8), p), F.pmod(hex_number(F.col(key), start + 8, 8), p)
        moved, other = f"_y{i % 2}", F.col(f"_y{1 - i % 2}")
        df = df.withColumn("_z", F.pmod(shift + slope * F.pmod(other, p), p))
        cube = F.pmod(F.pmod(F.col("_z") * F.col("_z"), p) * F.col("_z"), p)
        df = df.withColumn(moved, F.pmod(F.col(moved) + cube, columns if i % 2 else rows))
    place = F.col("_y0") * columns + F.col("_y1")
    return df.withColumn(out, F.explode(F.array(place))).drop("_y0", "_y1", "_z")


def turn_keys(*cols, seed: int = SEED) -> tuple[Column, Column]:
    """Two hex keys of a permutation."""
    return hash_key(*cols, seed=seed), hash_key(*cols, F.lit("turn"), seed=seed)


def index_catalog(items: DataFrame) -> DataFrame:
    """(item_id, pos): catalog in id order, numbered from 0."""
    return dense_index(items.select("item_id").distinct(), [F.col("item_id")], "pos")


def steps(df: DataFrame, length: str, out: str) -> DataFrame:
    """One row per 0..length-1, made chunk by chunk so that no row ever holds a long array."""
    chunks = df.filter(F.col(length) > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), ((F.col(length) - 1) / _CHUNK).cast("bigint"))))
    start = F.col("_chunk") * _CHUNK
    last = F.least(F.col(length), start + _CHUNK) - 1
    return chunks.withColumn(out, F.explode(F.sequence(start, last))).drop("_chunk")


def _first(df: DataFrame, order: list[Column], bucket: Column, longest: Column, wanted: str, rank: str) -> DataFrame:
    """First ``wanted`` rows per user; users with over TASK_ROWS rows are ranked in parts."""
    marked = df.withColumn("_bucket", bucket)
    ranked = bucketed_rank(marked, ["user_id"], "_bucket", order, longest > TASK_ROWS, rank)
    return ranked.filter(F.col(rank) <= F.col(wanted)).drop("_bucket")


def take_from_catalog(need: DataFrame, catalog: DataFrame, excluded: DataFrame, random: bool = False,
                      seed: int = SEED) -> DataFrame:
    """For each (user_id, m) the first m catalog items outside the user's exclusions.

    ``catalog`` is (item_id, pos 0..n-1); the walk follows ``pos``, or a random order per user.
    ``excluded`` holds distinct (user_id, item_id). Returns (user_id, item_id, step, rank).
    """
    n = catalog.count()
    rows, columns = grid(n) if random else (1, n)
    span = rows * columns
    barred = excluded.join(catalog, "item_id").select("user_id", "pos")
    barred_count = barred.groupBy("user_id").agg(F.count(F.lit(1)).alias("_e"))
    walk = (need.select("user_id", F.col("m").cast("bigint").alias("_m"))
            .join(barred_count, "user_id", "left")
            .withColumn("_len", F.when(F.col("_m") <= 0, F.lit(0)).otherwise(
                F.least(F.lit(span), F.col("_m") + F.coalesce("_e", F.lit(0)) + (span - n))).cast("bigint")))
    if random:
        first, second = turn_keys("user_id", seed=seed)
        walk = walk.withColumn("_k1", first).withColumn("_k2", second)
    walked = steps(walk, "_len", "step")
    walked = (scattered(walked, F.lit(rows), F.lit(columns), "pos").drop("_k1", "_k2") if random
              else walked.withColumn("pos", F.col("step")))
    open_steps = walked.filter(F.col("pos") < n).join(barred, ["user_id", "pos"], "left_anti")
    taken = _first(open_steps, [F.col("step")], (F.col("step") / TASK_ROWS).cast("bigint"), F.col("_len"), "_m", "rank")
    return taken.join(catalog, "pos").select("user_id", "item_id", "step", "rank")


# ---------------------------------------------------------------- weighted draws

_WEIGHTLESS = -(1 << 20)  # class of the items that come last
LEVELS = 4                # lengths of walks to a factor of two
TASK_STEPS = 2_000_000    # steps that a task walks


def weight_class(w: Column) -> Column:
    """Binary exponent of a positive weight; a weight a rounding error below a power of two counts as that power."""
    return F.when(w > 0, F.floor(F.log2(w) + F.lit(1e-9))).otherwise(F.lit(_WEIGHTLESS)).cast("bigint")


def classed_catalog(items: DataFrame, weights: DataFrame) -> tuple[DataFrame, list[dict]]:
    """(item_id, w, top, place): items numbered by class and id; and the classes, of which doubles allow about 2,100."""
    weighed = items.select("item_id").distinct().join(weights, "item_id", "left").select(
        "item_id", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    placed = dense_index(weighed.withColumn("_c", weight_class(F.col("w"))), [F.col("_c"), F.col("item_id")], "place")
    found = cut(placed.groupBy("_c").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"), F.max("w").alias("top")))
    classes = []
    for r in sorted(found.collect()):
        rows, columns = grid(r["n"])
        classes.append({"c": r["_c"], "start": r["start"], "n": r["n"], "top": r["top"], "rows": rows, "columns": columns})
    return placed.join(F.broadcast(found.select("_c", "top")), "_c").select("item_id", "w", "top", "place"), classes


def _levels(classes: list[dict]) -> list[tuple[float, list[int]]]:
    """How far to walk: (items surely expected, steps per class) for times LEVELS to a factor of two; at the end everything."""
    positive = [c for c in classes if c["c"] != _WEIGHTLESS]
    spans = [c["rows"] * c["columns"] for c in positive]
    out, everything = [], float(sum(c["n"] for c in positive))
    if positive:
        time = 0.5 / sum(c["n"] * c["top"] for c in positive)
        while True:
            reach = sum(c["n"] * -math.expm1(-2.0 ** c["c"] * time) for c in positive)
            lengths = [min(s, math.ceil(1.1 * s * -math.expm1(-c["top"] * time)) + 3) for c, s in zip(positive, spans)]
            if lengths == spans or reach > 0.99 * everything:
                break
            out.append((reach, lengths))
            time *= 2 ** (1 / LEVELS)
    return [*out, (math.inf, spans)]


def weighted_from_catalog(need: DataFrame, items: DataFrame, weights: DataFrame, excluded: DataFrame,
                          seed: int = SEED, inside: bool = False) -> DataFrame:
    """Per (user_id, m) the m first arrivals among the items outside the exclusions: (user_id, item_id, rank).

    That is drawing one after another in proportion to weight; items without weight come last, in random order. A round walks
    each class as far as the user's m + #excluded make likely to be enough, and knows every arrival up to the first moment
    that some class's walk ends at. Exclusions count with the share of the catalog that they are, and three deviations are added.
    Users with too few arrivals by then, as those who bar many of the heavy items, walk about four times as far in the next round.

    Users are dealt out once for the walk and once for the draw; in between a step goes to its item's place, with nothing but the
    user and the wait. Only users who may have over TASK_ROWS rows are walked and ranked in parts. ``inside`` says that all
    exclusions are items of the catalog.
    """
    catalog, classes = classed_catalog(items, weights)
    if not classes:
        return excluded.select("user_id", "item_id", F.lit(0).cast("bigint").alias("rank")).limit(0)
    levels = _levels(classes)
    positive = sum(c["n"] for c in classes if c["c"] != _WEIGHTLESS)
    if not inside:
        excluded = stored(excluded.select("user_id", "item_id").join(catalog.select("item_id"), "item_id", "left_semi"))
    barred = excluded.groupBy("user_id").agg(F.count(F.lit(1)).alias("_e"))
    users = (need.select("user_id", F.col("m").cast("bigint").alias("_m")).filter((F.col("_m") > 0) & F.col("user_id").isNotNull())
             .join(barred, "user_id", "left").withColumn("_b", F.col("_m") + F.coalesce("_e", F.lit(0))))
    reach = F.array(*[F.lit(r) for r, _ in levels])
    open_share = F.greatest(1 - (F.col("_b") - F.col("_m")) / float(max(positive, 1)), F.lit(1e-3))
    wanted = F.least((F.col("_m") + 3 * F.sqrt("_m") + 4) / open_share, F.col("_b") * 1.3 + 4)
    users = stored(users.withColumn("_reach", wanted).withColumn("_level", F.size(F.filter(reach, lambda r: r < F.col("_reach"))))
                   .select("user_id", "_m", "_b", "_level"))
    drawn, final, hidden = [], len(levels) - 1, excluded
    while True:
        sizes = users.groupBy("_level").agg(F.count(F.lit(1)), F.max("_b"), F.sum("_b")).collect()  # one row per length of walk
        if not sizes:
            break
        large = max(most for _, _, most, _ in sizes) > TASK_ROWS
        steps_made = sum(n * sum(levels[level][1]) + (whole if level == final else 0) for level, n, _, whole in sizes)
        tasks = max(int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")), steps_made // TASK_STEPS + 1)
        arrived = _arrivals(users, catalog, classes, [x for _, x in levels], positive, seed, None if large else tasks)
        best = stored(_drawn(arrived, hidden, users, None if large else tasks).select("user_id", "item_id", "rank"))
        got = best.groupBy("user_id").agg(F.count(F.lit(1)).alias("_got"))
        missing = (F.coalesce("_got", F.lit(0)) < F.col("_m")) & (F.col("_level") < final)
        users = stored(users.join(got, "user_id", "left").filter(missing).select(
            "user_id", "_m", "_b", F.least(F.col("_level") + 2 * LEVELS, F.lit(final)).alias("_level")))
        short = users.count()
        again = small(users.select("user_id"), short)
        drawn.append(best.join(again, "user_id", "left_anti") if short else best)
        hidden = excluded.join(again, "user_id", "left_semi")
    return reduce(DataFrame.unionByName, drawn, excluded.select("user_id", "item_id", F.lit(0).cast("bigint").alias("rank")).limit(0))


def _arrivals(users: DataFrame, catalog: DataFrame, classes: list[dict], lengths: list[list[int]], positive: int,
              seed: int, tasks: int | None) -> DataFrame:
    """(user_id, item_id, _tier, _arrival, _m): the items whose wait at the top rate is over by the user's end, the first moment that
    a class's walk ends at, and when they arrive; and per user one row without item that holds the end and ``_m``."""
    entries, i = [], 0
    for c in classes:
        span = c["rows"] * c["columns"]
        if c["c"] == _WEIGHTLESS:  # in the order of the permutation, as many as the others can leave open
            wanted = F.when(F.col("_level") == len(lengths) - 1, F.least(F.lit(span), F.greatest(
                F.col("_b") - positive, F.lit(0)) + (span - c["n"]) * (F.col("_b") > positive).cast("int"))).otherwise(0)
        else:
            wanted, i = F.element_at(F.array(*[F.lit(x[i]) for x in lengths]), F.col("_level") + 1), i + 1
        entries.append(F.struct(*[F.lit(c[k]).cast("bigint").alias(f"_{k}") for k in ("c", "start", "n", "rows", "columns")],
                                F.lit(c["top"]).alias("_top"), wanted.cast("bigint").alias("_len")))
    large = tasks is None
    dealt = users if large else users.repartition(tasks, "user_id")  # a user's steps are made and added up where the user is
    walk = dealt.withColumn("_class", F.explode(F.array(*entries))).select("user_id", "_m", "_b", "_class.*")
    keys = turn_keys("user_id", "_c", seed=seed)
    walk = steps(walk.withColumn("_k1", keys[0]).withColumn("_k2", keys[1]), "_len", "step")
    walk = scattered(walk, F.col("_rows"), F.col("_columns"), "_at").drop("_k1", "_k2")
    walk = walk.withColumn("_in", F.col("_at") < F.col("_n")).withColumn("_tier", (F.col("_c") == _WEIGHTLESS).cast("int"))
    group = ["user_id", "_c"]
    bucket, split = (F.col("step") / TASK_ROWS).cast("bigint"), F.lit(large) & (F.col("_b") > TASK_ROWS)
    walk = bucketed_sum(walk.withColumn("_bucket", bucket), group, "_bucket", "step", F.col("_in").cast("bigint"), split, large, "_j")
    left = (F.col("_n") - F.col("_j") + 1) * F.col("_top")  # _j counts this item too
    gap = F.when(F.col("_tier") == 1, F.lit(1.0)).otherwise(exponential_of(hash_key("user_id", "_c", "step", seed=seed)) / left)
    walk = bucketed_sum(walk, group, "_bucket", "step", F.when(F.col("_in"), gap).otherwise(0.0), split, large, "_wait")
    moment, done = F.struct("_tier", "_wait"), F.col("_j") == F.col("_n")
    if large:
        walk = cut(walk)
        ends = walk.groupBy(*group).agg(F.max(done).alias("_done"), F.max(moment).alias("_last")).groupBy("user_id").agg(
            F.min(F.when(~F.col("_done"), F.col("_last"))).alias("_end"), F.min("_c").alias("_least"))
        walk = walk.join(ends, "user_id")
    else:
        own, mine = Window.partitionBy(*group), Window.partitionBy("user_id")
        walk = walk.withColumn("_done", F.max(done).over(own)).withColumn("_last", F.max(moment).over(own)).withColumn(
            "_end", F.min(F.when(~F.col("_done"), F.col("_last"))).over(mine)).withColumn("_least", F.min("_c").over(mine))
    end = F.coalesce(F.col("_end"), F.struct(F.lit(1).alias("_tier"), F.lit(math.inf).alias("_wait")))
    reached = F.col("_in") & (moment <= end)
    sent = F.struct((F.col("_start") + F.col("_at")).alias("_place"), "_tier", "_wait", F.lit(None).cast("bigint").alias("_m"))
    # the end goes to no item, but not to one task either
    mark = F.struct((-1 - F.pmod(F.xxhash64("user_id"), F.lit(1 << 40))).alias("_place"), end["_tier"].alias("_tier"), end["_wait"].alias("_wait"),
                    F.col("_m"))
    marks = (F.col("_c") == F.col("_least")) & (F.col("step") == 0)
    some = F.filter(F.array(F.when(reached, sent), F.when(marks, mark)), lambda x: x.isNotNull())
    met = walk.select("user_id", F.inline(some)).join(
        catalog.select(F.col("place").alias("_place"), "item_id", "w", "top"), "_place", "left")
    pair = hash_key("user_id", "item_id", seed=seed)
    on = F.when((F.col("_tier") == 1) | F.col("item_id").isNull() | (unit_of(pair) < F.col("w") / F.col("top")), F.lit(0.0)).otherwise(
        exponential_of(pair, 14) / F.col("w"))
    return met.select("user_id", "item_id", "_tier", (F.col("_wait") + on).alias("_arrival"), "_m")


def _drawn(arrived: DataFrame, excluded: DataFrame, users: DataFrame, tasks: int | None) -> DataFrame:
    """The first ``_m`` arrivals per user up to the user's end that aren't excluded, with their rank."""
    none = F.lit(None)
    barred = excluded.filter(F.col("item_id").isNotNull()).select(
        "user_id", "item_id", none.cast("int").alias("_tier"), none.cast("double").alias("_arrival"), none.cast("bigint").alias("_m"))
    both = arrived.unionByName(barred)
    both = both.repartition(tasks, "user_id") if tasks else both
    moment = F.struct("_tier", "_arrival")
    merged = both.groupBy("user_id", "item_id").agg(
        F.min(F.when(F.col("_tier").isNotNull(), moment)).alias("_at"), F.bool_or(F.col("_tier").isNull()).alias("_barred"), F.max("_m").alias("_m"))
    told = F.col("item_id").isNull()
    if not tasks:
        merged = cut(merged)
        ends = merged.filter(told).select("user_id", F.col("_at").alias("_end"), "_m").join(users.select("user_id", "_b"), "user_id")
        known = merged.filter(~told).drop("_m").join(ends, "user_id")
    else:
        mine = Window.partitionBy("user_id")
        known = merged.withColumn("_end", F.max(F.when(told, F.col("_at"))).over(mine)).withColumn(
            "_m", F.max("_m").over(mine)).filter(~told)
    known = known.filter(~F.col("_barred") & (F.col("_at") <= F.col("_end")))
    if not tasks:
        return _earliest(known.select("user_id", "item_id", "_at.*", "_m", "_b"))
    order = [F.col("_at._tier"), F.col("_at._arrival"), F.col("item_id")]
    return known.withColumn("rank", F.row_number().over(mine.orderBy(*order)).cast("bigint")).filter(F.col("rank") <= F.col("_m"))


def _earliest(known: DataFrame) -> DataFrame:
    """First ``_m`` rows per user by arrival; users who may have over TASK_ROWS are ranked in bands of time."""
    split = F.col("_b") > TASK_ROWS
    band = F.when(~split, F.lit("")).otherwise(F.concat(F.col("_tier").cast("string"), F.when(
        F.col("_tier") == 1, F.lpad((F.col("_arrival") / TASK_ROWS).cast("bigint").cast("string"), 12, "0")).otherwise(
        F.lpad((F.floor(F.log2("_arrival") * 64) + 100_000).cast("string"), 7, "0"))))
    order = [F.col("_tier"), F.col("_arrival"), F.col("item_id")]
    ranked = bucketed_rank(known.withColumn("_band", band), ["user_id"], "_band", order, split, "rank")
    return ranked.filter(F.col("rank") <= F.col("_m"))


def item_weights(interactions: DataFrame, strategy: str) -> DataFrame:
    """(item_id, w): row count, or its inverse."""
    pop = item_popularity(interactions)
    if strategy == "popularity":
        return pop.select("item_id", F.col("pop").cast("double").alias("w"))
    if strategy == "popularity_inverse":
        return pop.select("item_id", (F.lit(1.0) / F.col("pop")).alias("w"))
    raise ValueError(f"unknown sampling strategy: {strategy}")


def training_negatives(interactions: DataFrame, items: DataFrame, ratio: float = 1.0, strategy: str = "random",
                       seed: int = SEED) -> DataFrame:
    """Unseen items per user, min(#unseen, int(#distinct positives * ratio)) of them."""
    catalog = index_catalog(items)
    n = catalog.count()
    interactions = stored(interactions.select("user_id", "item_id"))
    seen = stored(user_history(interactions).join(small(catalog.select("item_id"), n), "item_id", "left_semi"))
    need = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("_p")).select(
        "user_id", F.least(F.lit(n) - F.col("_p"), F.floor(F.col("_p") * F.lit(float(ratio)))).alias("m"))
    if strategy == "random":
        return take_from_catalog(need, catalog, seen, random=True, seed=seed).select("user_id", "item_id", "rank")
    return weighted_from_catalog(need, catalog, item_weights(interactions, strategy), seen, seed, inside=True)


def train_samples(interactions: DataFrame, items: DataFrame, ratio: float = 1.0, strategy: str = "random",
                  seed: int = SEED) -> DataFrame:
    """All positive rows (label 1) and the sampled negatives (label 0), with a seeded shuffle key."""
    known = interactions.join(items.select("item_id").distinct(), "item_id", "left_semi")
    positives = known.select("user_id", "item_id", F.lit(1).alias("label"))
    negatives = training_negatives(interactions, items, ratio, strategy, seed).select(
        "user_id", "item_id", F.lit(0).alias("label"))
    return positives.unionByName(negatives).withColumn("order_key", hash_key("user_id", "item_id", "label", seed=seed))


def eval_candidates(test: DataFrame, items: DataFrame, negatives: int = 100, strategy: str = "random",
                    seed: int = SEED) -> DataFrame:
    """Per test user the positives and ``negatives`` other catalog items: (user_id, item_id, positive).

    Weights are counts in the test rows; items absent there count once.
    """
    catalog = index_catalog(items)
    n = catalog.count()
    positives = cut(test.select("user_id", "item_id").distinct())
    inside = positives.join(catalog.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_p"))
    need = (positives.select("user_id").distinct().join(inside, "user_id", "left").fillna(0, ["_p"])
            .select("user_id", F.least(F.lit(negatives), F.lit(n) - F.col("_p")).alias("m")))
    if strategy == "random":
        sampled = take_from_catalog(need, catalog, positives, random=True, seed=seed)
    else:
        known = item_weights(test, strategy)
        weights = catalog.select("item_id").join(known, "item_id", "left").fillna(1.0, ["w"])
        sampled = weighted_from_catalog(need, catalog, weights, positives, seed)
    return (positives.withColumn("positive", F.lit(1))
            .unionByName(sampled.select("user_id", "item_id", F.lit(0).alias("positive"))))
