"""Splits and samplers: exact sizes, invariants, both routes of a switch."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import ranking, sampling, splits
from tastegrid.plans import split_job
from tastegrid.session import cut


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"r{n:04}", f"u{n % 17}", f"i{n * n % 40}", datetime(2023, 1, 1) + timedelta(hours=7 * n), f"t{n % 3}") for n in range(400)]
    return spark.createDataFrame(data, "row_id string, user_id string, item_id string, timestamp timestamp, tag string")


def counts(df):
    return Counter(r.split for r in df.select("split").collect())


def test_sizes(rows):
    assert counts(splits.temporal_split(rows)) == {"train": 320, "val": 80}
    assert counts(splits.simple_random_split(rows, 0.8)) == {"train": 320, "val": 80}
    got = counts(splits.column_stratified_split(rows, 0.7, 0.15, 0.15, "tag"))
    assert got == {"train": 280, "val": 60, "test": 60}
    one = counts(splits.leave_one_out_split(rows))
    assert one["test"] == one["val"] == 17
    with pytest.raises(ValueError):
        splits.column_stratified_split(rows, 0.5, 0.1, 0.1, "tag")
    with pytest.raises(ValueError):
        splits.split(rows, "absent")


def test_entities_stay_apart(rows):
    done = splits.user_based_split(rows, 0.5, 5)
    users = {s: {r.user_id for r in done.filter(F.col("split") == s).collect()} for s in ("train", "val")}
    assert len(users["train"]) == 8 and not users["train"] & users["val"]
    later = splits.stratified_temporal_split(rows, 0.6, 0.2, 0.2, stratify_by="tag")
    check = splits.leakage_check(later).first()
    assert check.ordered and check.users_without_train == 0
    assert set(counts(splits.cold_start_split(rows))) <= {"train", "val_warm", "val_cold_user", "val_cold_item", "val_cold_both"}


def test_quotas_follow_largest_remainders(spark):
    strata = spark.createDataFrame([(f"s{i:02}", c) for i, c in enumerate((5, 3, 9, 1, 7, 7))], "stratum string, rows bigint")
    got = {r.stratum: r.q for r in splits.largest_remainder(strata, "rows", 13, "q").collect()}
    sizes = {r.stratum: r.rows for r in strata.collect()}
    want = {s: c * 13 // 32 for s, c in sizes.items()}
    for s in sorted(sizes, key=lambda s: (-(sizes[s] * 13 % 32), s))[:13 - sum(want.values())]:
        want[s] += 1
    assert got == want


def test_ranks_in_parts_equal_plain_ranks(rows):
    keyed = rows.withColumn("_key", F.md5("row_id"))
    plain = {r.row_id: (r.rn, r.n) for r in ranking.rank_within(keyed, ["user_id"], "_key").collect()}
    parts = {r.row_id: (r.rn, r.n) for r in ranking.rank_within(keyed, ["user_id"], "_key", task_rows=2).collect()}
    assert plain == parts


def test_key_at_a_position_equals_a_sort(rows, spark):
    """Exact sketches and coarse ones, ties, shares that are far off, both ends, an empty table."""
    x = F.substring("row_id", 2, 3).cast("int")  # ten rows share a number
    key = [F.col("row_id")]
    for n in (1, 37, 200, 399, 400):
        for share, sketch in ((n / 400, 10_000), (n / 400, 3), (0.5, 10_000), (0.0, 50), (1.0, 50)):
            got = ranking.nth_key(rows, x, key, share, lambda _: n, sketch)
            assert got == (400, (f"r{n - 1:04}",)), (n, share, sketch)
    assert ranking.nth_key(rows, x, key, 0.5, lambda n: 0) == (400, None)
    assert ranking.nth_key(rows.limit(0), x, key, 0.5, lambda n: n) == (0, None)
    gaps = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (2, "d")], "t int, r string")
    assert [ranking.nth_key(gaps, F.col("t"), [F.col("t"), F.col("r")], 0.5, lambda _: n)[1][1] for n in (1, 2, 3, 4)] == list("abcd")


def test_subsets_are_nested(rows):
    got = Counter(r.level for r in splits.training_subsets(rows).select("level").collect())
    assert sum(n for level, n in got.items() if level >= 1) == 200
    assert sum(n for level, n in got.items() if level >= 2) == 80
    assert got[3] == 20


def test_split_job(rows, spark, tmp_path):
    items = spark.createDataFrame([(f"i{n}", f"t{n % 3}") for n in range(40)], "item_id string, tag string")
    stats = split_job.run(rows.drop("tag"), items, str(tmp_path / "s"), "stratified_by_column", stratify_by="tag",
                          train_ratio=0.7, val_ratio=0.15, test_ratio=0.15).first()
    assert stats.train_rows == pytest.approx(0.7 * (stats.train_rows + stats.val_rows + stats.test_rows), abs=1)


@pytest.mark.parametrize("strategy", ["random", "popularity", "popularity_inverse"])
def test_negatives(spark, rows, strategy):
    items = spark.createDataFrame([(f"i{n}",) for n in range(60)], "item_id string")
    seen = {(r.user_id, r.item_id) for r in rows.collect()}
    got = [(r.user_id, r.item_id) for r in sampling.training_negatives(rows, items, 1.0, strategy).collect()]
    assert len(got) == len(set(got)) and not set(got) & seen
    positives = Counter(u for u, _ in seen)
    assert Counter(u for u, _ in got) == {u: min(60 - p, p) for u, p in positives.items()}


def test_evaluation_candidates(spark, rows):
    items = spark.createDataFrame([(f"i{n}",) for n in range(60)], "item_id string")
    got = sampling.eval_candidates(rows, items, 10).groupBy("user_id").agg(F.sum("positive").alias("p"), F.count("*").alias("n"))
    assert all(r.n == r.p + 10 for r in got.collect())


def test_uniform_draws_cover_items_and_pairs_evenly(spark):
    """3,000 users draw 3 of 11 items: each item and each pair of items about equally often."""
    items = spark.createDataFrame([(f"i{n:02}",) for n in range(11)], "item_id string")
    need = spark.createDataFrame([(f"u{n}", 3) for n in range(3_000)], "user_id string, m int")
    none = spark.createDataFrame([], "user_id string, item_id string")
    drawn = {}
    for r in sampling.take_from_catalog(need, sampling.index_catalog(items), none, random=True).collect():
        drawn.setdefault(r.user_id, set()).add(r.item_id)
    assert {len(s) for s in drawn.values()} == {3}
    single = Counter(i for s in drawn.values() for i in s)
    pairs = Counter(frozenset((a, b)) for s in drawn.values() for a in s for b in s if a < b)
    assert all(abs(c - 3_000 * 3 / 11) < 130 for c in single.values())
    assert len(pairs) == 55 and all(abs(c - 3_000 * 6 / 110) < 75 for c in pairs.values())
    assert len({frozenset(s) for s in drawn.values()}) > 120


def drawn(need, items, weights, barred):
    got = sampling.weighted_from_catalog(need, items, weights, barred).collect()
    return sorted((r.user_id, r["rank"], r.item_id) for r in got)


@pytest.fixture(scope="module")
def skewed(spark):
    weights = {f"i{n:02}": w for n, w in enumerate([1e6, 3.0, 2.9, 1.0, 1.0, 0.5, 1e-3, 1e-9, 0.0, None])}
    items = spark.createDataFrame([(i,) for i in [*weights, "i98", "i99"]], "item_id string")
    return items, spark.createDataFrame([*weights.items(), ("absent", 5.0)], "item_id string, w double")


def test_weighted_draws_of_a_skewed_catalog(spark, skewed):
    """All 12 items for 400 users: the heaviest first, weightless ones last, the order of the others in proportion to weight."""
    need = spark.createDataFrame([(f"u{n}", 12) for n in range(400)], "user_id string, m int")
    none = spark.createDataFrame([], "user_id string, item_id string")
    lists = {}
    for u, rank, i in drawn(need, *skewed, none):
        lists.setdefault(u, []).append((rank, i))
    assert all([r for r, _ in x] == list(range(1, 13)) and len({i for _, i in x}) == 12 for x in lists.values())
    order = [[i for _, i in x] for x in lists.values()]
    assert all(x[0] == "i00" and x[7] == "i07" and set(x[8:]) == {"i08", "i09", "i98", "i99"} for x in order)
    second = Counter(x[1] for x in order)
    assert all(abs(second[i] - 400 * w / 8.401) < 45 for i, w in (("i01", 3.0), ("i02", 2.9), ("i03", 1.0), ("i04", 1.0), ("i05", 0.5)))
    assert all(abs(c - 100) < 40 for c in Counter(x[8] for x in order).values())


def test_weighted_draws_do_not_depend_on_the_walk(spark, monkeypatch):
    """Short first walks, many rounds, groups ranked in parts: the same rows."""
    weights = [(f"i{n:02}", 2.0 ** (n % 4) * (1 + n / 100) if n % 9 else 0.0) for n in range(60)]
    skewed = (spark.createDataFrame([(i,) for i, _ in weights], "item_id string"),
              spark.createDataFrame(weights, "item_id string, w double"))
    need = spark.createDataFrame([(f"u{n}", 1 + n % 42) for n in range(40)], "user_id string, m int")
    barred = spark.createDataFrame([(f"u{n}", f"i{k:02}") for n in range(40) for k in range(60) if (n * 7 + k * 3) % 10 < 3],
                                   "user_id string, item_id string")
    want = drawn(need, *skewed, barred)
    held = {(r.user_id, r.item_id) for r in barred.collect()}
    assert Counter(u for u, _, _ in want) == {f"u{n}": 1 + n % 42 for n in range(40)}
    assert not {(u, i) for u, _, i in want} & held
    levels = sampling._levels
    monkeypatch.setattr(sampling, "_levels", lambda c: [(1e9, [n] * len(levels(c)[0][1])) for n in (1, 1, 2, 5)] + levels(c)[-1:])
    assert drawn(need, *skewed, barred) == want
    monkeypatch.setattr(sampling, "_levels", lambda c: levels(c)[-1:])
    monkeypatch.setattr(sampling, "TASK_ROWS", 2)
    assert drawn(need, *skewed, barred) == want


def test_grid_is_tight_and_scatters_all_places(spark):
    for n in (1, 2, 3, 11, 97, 2_000, 2 ** 33 + 5):
        rows_, columns = sampling.grid(n)
        assert rows_ * columns >= n and rows_ * columns - n <= max(1, n // 50)
    df = spark.range(7).select(F.col("id").cast("string").alias("user_id"))
    first, second = sampling.turn_keys("user_id")
    walked = sampling.steps(df.withColumns({"_k1": first, "_k2": second, "_len": F.lit(132)}), "_len", "step")
    got = sampling.scattered(walked, F.lit(11), F.lit(12), "pos").groupBy("user_id").agg(
        F.count_distinct("pos").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")).collect()
    assert {(r.n, r.low, r.high) for r in got} == {(132, 0, 131)}
    wide = sampling.grid(2 ** 40)
    big = sampling.scattered(walked, F.lit(wide[0]), F.lit(wide[1]), "pos").select("pos").collect()
    assert len(big) == 924 and all(0 <= r.pos < wide[0] * wide[1] for r in big) and max(r.pos for r in big) > 2 ** 39
def test_training_subsets_of_rows_in_several_partitions(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS event_id", "id % 30 AS user_id", "timestamp_seconds(id * 977 % 5003) AS ts")
    rows.repartition(6).write.parquet(f"{tmp_path}/events")
    df = spark.read.parquet(f"{tmp_path}/events").selectExpr("CAST(event_id AS string) AS row_id", "ts AS timestamp")
    labelled = splits.training_subsets(df).select("timestamp", "level")
    assert "lambda" not in labelled._jdf.queryExecution().optimizedPlan().toString()  # Spark loses a column under one in a grouping
    subsets = cut(labelled).groupBy("level").count().collect()
    assert {r["level"]: r["count"] for r in subsets} == {0: 2000, 1: 1200, 2: 600, 3: 200}


def test_walks_of_weighted_draws_end_soon_after_what_is_drawn(spark, monkeypatch):
    items = spark.range(3000).selectExpr("CAST(id AS string) AS item_id", "1.0D / (1 + id % 40) AS w")
    need = spark.range(30).selectExpr("CAST(id AS string) AS user_id", "40 AS m")
    barred = spark.range(30 * 35).selectExpr("CAST(id % 30 AS string) AS user_id", "CAST(id * 71 % 3000 AS string) AS item_id")
    rows, whole = [], sampling._arrivals
    monkeypatch.setattr(sampling, "_arrivals", lambda *x: rows.append(whole(*x)) or rows[-1])
    draw = lambda: {tuple(r) for r in sampling.weighted_from_catalog(need, items.select("item_id"), items, barred).collect()}
    drawn = draw()
    assert len(drawn) == 30 * 40 and sum(r.count() for r in rows) < 5 * len(drawn)
    monkeypatch.setattr(sampling, "LEVELS", 1)
    assert draw() == drawn


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_row(df):
    return {r.row_id: r.split for r in df.select("row_id", "split").collect()}


def test_stratum_is_joined_to_later_rows_only(spark, rows):
    """The column of the item table comes to the rows that are shared out by it; the rows are read from one stored table."""
    items = spark.createDataFrame([(f"i{n}", f"t{n % 3}") for n in range(40) if n % 7], "item_id string, tag string")
    with_tag, column = splits.attach_stratum(rows.drop("tag"), items, "tag")
    want = by_row(splits.stratified_temporal_split(with_tag, 0.6, 0.2, 0.2, stratify_by=column))
    got = splits.stratified_temporal_split(rows.drop("tag"), 0.6, 0.2, 0.2, stratify_by="tag", items=items)
    assert by_row(got) == want and Counter(want.values())["train"] == 240
    assert "Join" not in plan_of(got.filter(F.col("split") == "train").select("row_id"))


def test_cold_start_labels_all_rows_in_one_pass(rows):
    done = splits.cold_start_split(rows.withColumn("user_id", F.when(F.col("row_id") < "r0003", F.lit("rare")).otherwise(F.col("user_id"))))
    got = by_row(done)
    assert len(got) == 400 and done.count() == 400 and "Union" not in plan_of(done)
    assert all(got[f"r{n:04}"] in ("val_cold_user", "val_cold_both") for n in range(3))
    warm = Counter((r.user_id, r.split) for r in done.filter(F.col("split").isin("train", "val_warm")).collect())
    for u in {u for u, _ in warm}:
        n = warm[u, "train"] + warm[u, "val_warm"]
        assert n < 3 or warm[u, "train"] == min(max(1, int(n * 0.8)), n - 1)


def test_rows_of_leave_one_out_move_once(rows, monkeypatch):
    from tastegrid.operators import filtering

    done = splits.leave_one_out_split(rows)
    want = by_row(done)
    assert "Join" not in plan_of(done)
    monkeypatch.setattr(splits, "TASK_ROWS", 5)
    assert by_row(splits.leave_one_out_split(rows)) == want
    kept = filtering.filter_by_activity(rows, 20, 3)
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(filtering, "BROADCAST_ROWS", -1)
    assert sorted(kept.collect()) == sorted(filtering.filter_by_activity(rows, 20, 3).select(*kept.columns).collect())


def test_weighted_draws_move_a_step_there_and_back_only(spark):
    """Users are dealt out once for the walk and once for the draw, a step goes to its item; no other exchange holds steps."""
    items = spark.range(300).selectExpr("CAST(id AS string) AS item_id", "1.0D / (1 + id % 7) AS w")
    need = spark.range(20).selectExpr("CAST(id AS string) AS user_id", "9 AS m", "9L AS _m", "12L AS _b", "0 AS _level")
    barred = spark.range(60).selectExpr("CAST(id % 20 AS string) AS user_id", "CAST(id * 7 % 300 AS string) AS item_id")
    catalog, classes = sampling.classed_catalog(items.select("item_id"), items)
    lengths = [x for _, x in sampling._levels(classes)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arrived = sampling._arrivals(need, catalog, classes, lengths, 300, 42, 3)
        plan = sampling._drawn(arrived, barred, need, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_part#" not in line]
    assert len(moved) == 4 and sum("_place" in line for line in moved) == 2, moved  # the walk, steps to items (both sides), the draw
    got = {(r.user_id, r.item_id) for r in sampling.weighted_from_catalog(need.select("user_id", "m"), items, items, barred).collect()}
    assert len(got) == 20 * 9 and not got & {(r.user_id, r.item_id) for r in barred.collect()}
