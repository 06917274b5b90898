"""Filtering, text, encoding, scaling, feature rows and sources on literal tables."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tastegrid.functions import text as tx
from tastegrid.operators import encoding, features, filtering
from tastegrid.plans import preprocess
from tastegrid.sources import images, state, tables


def pairs(spark, *rows):
    return spark.createDataFrame([(f"user{u}", f"item{i}") for u, i in rows], "user_id string, item_id string")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture()
def seven(spark):
    return pairs(spark, (1, 1), (1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 1))


def test_activity_and_valid_items(spark, seven):
    valid = spark.createDataFrame([("item1",), ("item2",), ("item3",)], "item_id string")
    assert filtering.keep_valid_items(seven, valid).count() == 6
    assert filtering.filter_by_activity(seven, 2, 0).count() == 6
    assert filtering.filter_by_activity(seven, 0, 2).count() == 5
    assert rows_of(filtering.filter_by_activity(seven, 2, 2), "user_id", "item_id") == [("user1", "item1"), ("user1", "item2")]
    assert filtering.filter_by_activity(seven, 0, 0).count() == 7


def test_align_and_retention(spark, seven):
    items = spark.createDataFrame([(f"item{i}", f"t{i}") for i in range(1, 6)], "item_id string, title string")
    aligned = filtering.align_items(items, seven)
    assert aligned.count() == 4
    kept = filtering.filter_by_activity(seven, 0, 2)
    got = {r.entity: r.retention for r in filtering.filtering_stats(seven, kept, items, filtering.align_items(items, kept)).collect()}
    assert got["interactions"] == pytest.approx(5 / 7) and got["items"] == pytest.approx(2 / 5)


def test_text_cleaning(spark):
    df = spark.createDataFrame([(1, "  <b>A Title</b> with  HTML "), (2, None), (3, "ﬁnal\n\tdescription.")], "id int, text string")
    got = {r.id: r.t for r in df.select("id", tx.clean_text(F.col("text")).alias("t")).collect()}
    assert got == {1: "a title with html", 2: "", 3: "final description."}
    both = spark.createDataFrame([(" a ", None, "b"), (None, " ", None)], "x string, y string, z string")
    assert [r[0] for r in both.select(tx.combined_text(both, ["x", "y", "absent", "z"], "-")).collect()] == ["a-b", ""]


def test_labels_scaling_and_vectors(spark):
    df = spark.createDataFrame([("b", 10.0), ("a", 20.0), ("b", None), (None, 40.0), ("c", 50.0)], "tag string, n double")
    labels = encoding.fit_labels(filtering.fill_tag(df), "tag")
    assert rows_of(labels, "value", "idx") == [("a", 0), ("b", 1), ("c", 2), ("unknown", 3)]
    stats = encoding.fit_scaler(df, ["n"])
    scaled = [r.n for r in encoding.scale(df, ["n"], stats).collect()]
    assert sum(scaled) == pytest.approx(0) and sum(x * x for x in scaled) / 5 == pytest.approx(1)
    low = [r.n for r in encoding.scale(df, ["n"], stats, "min_max").collect()]
    assert (min(low), max(low)) == (0.0, 1.0)
    constant = spark.createDataFrame([(3.0,), (3.0,)], "n double")
    assert {r.n for r in encoding.scale(constant, ["n"], encoding.fit_scaler(constant, ["n"])).collect()} == {0.0}
    messy = spark.createDataFrame([("7",), ("x",), (None,)], "n string")
    assert [r.numeric for r in features.numeric_vector(messy, ["n"]).collect()] == [[7.0], [0.0], [0.0]]


def test_unknown_labels(spark):
    labels = spark.createDataFrame([("a", 0)], "value string, idx bigint")
    df = spark.createDataFrame([("a",), ("z",)], "tag string")
    assert encoding.encode(df, "tag", labels, "i").count() == 1
    assert rows_of(encoding.encode(df, "tag", labels, "i", "null").filter("i is null"), "tag") == [("z",)]


def png(width: int, height: int) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    data = zlib.compress(b"".join(b"\0" + b"\x7f" * 3 * width for _ in range(height)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def test_images_from_files(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png(200, 120))
    (tmp_path / "small.png").write_bytes(png(30, 30))
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "both.png").write_bytes(png(90, 90))
    (tmp_path / "both.jpg").write_bytes(b"no image")
    (tmp_path / "other.gif").write_bytes(b"GIF89a")
    items = spark.createDataFrame([(x,) for x in ("good", "small", "broken", "both", "other", "absent")], "item_id string")
    sizes = images.decode_images(spark, str(tmp_path))
    listing = images.list_images(spark, str(tmp_path)).join(sizes, "path", "left").fillna(-1, ["width", "height"])
    found = images.find_images(items, listing)
    assert rows_of(found, "item_id", "ext") == [("both", ".jpg"), ("broken", ".jpg"), ("good", ".png"), ("small", ".png")]
    assert rows_of(images.valid_images(found, 50, 50), "item_id") == [("good",)]
    manifest = {r.item_id: r for r in images.compression_manifest(found, 0.0, 100).collect()}
    assert (manifest["good"].target_width, manifest["good"].target_height) == (100, 60)


def test_sinks_state_and_users(spark, tmp_path, seven):
    path = str(tmp_path)
    tables.write_split(seven.withColumn("split", F.lit("train")), f"{path}/split")
    assert spark.read.parquet(f"{path}/split").filter("split = 'train'").count() == 7
    tables.write_table(seven, f"{path}/csv", "csv")
    assert tables.read_raw(spark, f"{path}/csv").count() == 7
    recs = seven.withColumns({"score": F.lit(0.5), "rank": F.lit(1)})
    tables.write_recommendations(recs, f"{path}/recs")
    assert spark.read.json(f"{path}/recs").count() == 4
    tables.write_metrics(spark.createDataFrame([(0.5,)], "mrr double"), f"{path}/metrics", run="r1")
    assert spark.read.json(f"{path}/metrics").first().run == "r1"
    calls = []
    fit = lambda: calls.append(1) or spark.createDataFrame([("a", 0)], "value string, idx int")
    for _ in range(2):
        assert state.fit_or_load(spark, f"{path}/state", fit).count() == 1
    assert len(calls) == 1
    items = spark.createDataFrame([(f"i{n}",) for n in range(5)], "item_id string")
    build = lambda df: df.withColumn("x", F.lit(1))
    assert state.materialize_features(items, build, f"{path}/f", max_items=2).count() == 2
    assert state.materialize_features(items, build, f"{path}/f").count() == 5
    assert state.materialize_features(items, build, f"{path}/f", force=True).count() == 5
    (tmp_path / "users.txt").write_text("user2\n\n  \nuser9\n")
    assert rows_of(tables.users_from_file(spark, f"{path}/users.txt"), "user_id") == [("user2",), ("user9",)]
    assert tables.users_from_list(spark, [1, 2]).count() == 2
    assert rows_of(tables.first_users(seven, 2), "user_id") == [("user1",), ("user2",)]
    assert tables.sample_users(seven, 3).count() == 3


def test_preprocess_run(spark, tmp_path):
    items = spark.createDataFrame([(f"item{i}", f"<i>T{i}</i>", None if i == 2 else "x", 1.0 * i) for i in range(1, 8)],
                                  "item_id string, title string, tag string, views double")
    valid = spark.createDataFrame([(f"item{i}",) for i in (1, 2, 3, 5)], "item_id string")
    rows = pairs(spark, (1, 1), (1, 2), (1, 1), (2, 2), (2, 1), (2, 2), (3, 3))
    got = preprocess.run(items, rows, str(tmp_path / "out"), valid_ids=valid, text_columns=["title"], numeric=["views", "absent"],
                         min_user=2, min_item=2).first()
    assert (got.interactions, got.users, got["items"], got.interacted_items) == (6, 2, 2, 2)
    assert rows_of(spark.read.parquet(str(tmp_path / "out/items")), "item_id", "title", "tag") == [("item1", "t1", "x"), ("item2", "t2", "unknown")]


def test_features_survive_killed_and_competing_runs(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "features")
    items = spark.createDataFrame([(f"item{i}", float(i)) for i in range(9)], "item_id string, x double")
    build = lambda df: df.withColumn("y", F.col("x") * 2)
    stored = lambda df: sorted((r.item_id, r.y) for r in df.collect())
    whole = [(f"item{i}", 2.0 * i) for i in range(9)]
    assert len(stored(state.materialize_features(items.limit(3), build, path))) == 3
    before = state.PartedTable(spark, path).version()

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:  # the rows are written, the manifest isn't
        patch.setattr(state.PartedTable, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            state.materialize_features(items, build, path)
    assert state.PartedTable(spark, path).version() == before

    def competing(df):  # another run brings some of the same items in between
        state.materialize_features(items.filter("x < 7"), build, path)
        return build(df)

    assert stored(state.materialize_features(items, competing, path)) == whole
    assert stored(state.materialize_features(items, build, path)) == whole
    assert stored(state.materialize_features(items.filter("x < 2"), build, path, force=True)) == whole[:2]


def test_swapped_words_of_long_texts(spark):
    """Against the pass itself; the text is not copied once per word."""
    texts = {n: " ".join(f"w{i}" for i in range(n)) for n in (1, 2, 3, 50, 3_000)} | {-1: None, 0: "  ", -2: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    for prob in (0.0, 0.3, 1.0):
        out = df.select("doc_id", tx.augment_swap(F.col("text"), F.col("doc_id"), prob).alias("out"))
        draws = df.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3_000))).alias("i")).select(
            "doc_id", "i", (tx.u01("doc_id", "i") < prob).alias("swap"))
        swaps = {(r.doc_id, r.i) for r in draws.filter("swap").collect()}
        for r in out.collect():
            words = (texts[r.doc_id] or "").split()
            for i in range(len(words) - 1):
                if (r.doc_id, i) in swaps:
                    words[i], words[i + 1] = words[i + 1], words[i]
            assert r.out == " ".join(words), (r.doc_id, prob)
        assert "array_append" not in out._jdf.queryExecution().optimizedPlan().toString()
