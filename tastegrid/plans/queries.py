"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions import text as tx
from tastegrid.functions.hashing import hash_key, u01
from tastegrid.functions.vectors import as_doubles, cosine
from tastegrid.operators import accuracy, encoding, fairness, features, filtering, losses, novelty, sampling, scorer
from tastegrid.operators import recommend as rec
from tastegrid.operators import similarity as sim
from tastegrid.operators import splits
from tastegrid.operators.nearest import nearest
from tastegrid.operators.ranking import dense_index, small, top_k
from tastegrid.plans import evaluate, preprocess, split_job
from tastegrid.plans.bindings import Views
from tastegrid.session import checkpoint_dir, cut, stored
from tastegrid.sources import images, tables
from tastegrid.sources.state import materialize_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K = 10


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: whole numbers as bigint, fractions at 6 places without a negative zero."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind in ("float", "double"):
            col = F.round(col.cast("double"), 6) + F.lit(0.0)
        out.append(col.alias(name))
    return df.select(*out)


def query(name: str):
    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(build(Views(spark, folder)))
        return build
    return register


# ---------------------------------------------------------------- shared inputs

def purchase_data(v: Views) -> tuple[rec.RecommenderData, DataFrame]:
    """Purchases split in time: history is the first 80 %, test the rest. Order lines are joined with their orders once."""
    rows = stored(v.purchases.select("row_id", "user_id", "item_id", "timestamp"))
    halves = splits.temporal_split(rows, train_ratio=0.8)
    history = halves.filter(F.col("split") == "train").drop("split")
    return rec.RecommenderData(rows, v.items, history), halves.filter(F.col("split") == "val").drop("split")


def click_data(v: Views, keep: bool = False) -> tuple[rec.RecommenderData, DataFrame]:
    """Clicks split in time like purchases; ``keep`` stores them, for queries that read them many times."""
    rows = stored(v.clicks) if keep else v.clicks
    halves = splits.temporal_split(rows, train_ratio=0.8)
    history = halves.filter(F.col("split") == "train").drop("split")
    return rec.RecommenderData(rows, v.items, history), halves.filter(F.col("split") == "val").drop("split")


def purchase_recs(v: Views) -> tuple[DataFrame, rec.RecommenderData, DataFrame]:
    data, test = purchase_data(v)
    return cut(rec.recommend_popularity(data, test.select("user_id").distinct(), K)), data, test


def click_recs(v: Views) -> tuple[DataFrame, rec.RecommenderData, DataFrame]:
    """Random lists over the whole catalog; measures of vectors pass over items without an embedding."""
    data, test = click_data(v)
    return cut(rec.recommend_random(data, test.select("user_id").distinct(), K)), data, test


# ---------------------------------------------------------------- sources

@query("load_interactions")
def _(v):
    raw = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("timestamp"))
    return tables.load_interactions(raw)


@query("load_items")
def _(v):
    raw = v.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
                                 F.when(F.col("p_size") > 5, F.col("p_size")).alias("size"),
                                 F.col("p_retailprice").cast("string").alias("price"))
    return tables.load_items(raw, ["size", "price", "comment_number"])[0]


def image_listing(v: Views) -> DataFrame:
    """One or two file entries per part, with endings, bytes and sizes taken from its columns."""
    endings = F.when(F.col("p_size") % 7 == 0, F.array(F.lit(".gif"))).when(
        F.col("p_size") % 3 == 0, F.array(F.lit(".png"), F.lit(".jpg"))).otherwise(F.array(F.lit(".jpeg")))
    return (v.table("part").withColumn("e", F.explode(endings))
            .select(F.concat(F.lit("file:/images/"), F.col("p_partkey").cast("string"), "e").alias("path"),
                    (F.col("p_size") * 40_000).cast("bigint").alias("length"),
                    F.when(F.col("p_size") % 11 == 0, F.lit(-1)).otherwise(F.col("p_size") * 60).alias("width"),
                    F.when(F.col("p_size") % 11 == 0, F.lit(-1)).otherwise(F.col("p_size") * 35).alias("height")))


@query("image_lookup")
def _(v):
    return images.find_images(v.items, image_listing(v)).select("item_id", "path", "ext")


@query("valid_images")
def _(v):
    return images.valid_images(images.find_images(v.items, image_listing(v)), 200, 200)


@query("image_manifest")
def _(v):
    return images.compression_manifest(images.find_images(v.items, image_listing(v)))


@query("items_with_images")
def _(v):
    valid = images.valid_images(images.find_images(v.items, image_listing(v)), 200, 200)
    return filtering.keep_valid_items(v.items, valid)


@query("recs_nested")
def _(v):
    recs, _, _ = purchase_recs(v)
    entry = lambda e: F.concat_ws(":", e["item_id"], F.format_string("%.6f", e["score"]))
    return rec.nest(recs).select("user_id", F.array_join(F.transform("recommendations", entry), ",").alias("recommendations"))


@query("feature_table_incremental")
def _(v):
    import uuid
    path = f"{checkpoint_dir(v.spark)}/features-{uuid.uuid4().hex}"
    build = lambda items: features.numeric_vector(items, ["size", "price"], None, "log1p").select("item_id", "numeric")
    half = v.items.filter(F.col("size") > 25)
    materialize_features(half, build, path)
    full = materialize_features(v.items, build, path)
    return full.select("item_id", F.col("numeric")[0].alias("log_size"), F.col("numeric")[1].alias("log_price"))


@query("target_users_sample")
def _(v):
    return tables.sample_users(v.purchases, 20)


# ---------------------------------------------------------------- cleaning

@query("valid_item_filter")
def _(v):
    return filtering.keep_valid_items(v.purchases, v.items.filter(F.col("size") >= 10)).select("row_id", "user_id", "item_id")


@query("activity_filter")
def _(v):
    return filtering.filter_by_activity(v.purchases, 40, 30).select("row_id", "user_id", "item_id")


@query("align_items")
def _(v):
    return filtering.align_items(v.items, v.clicks).select("item_id", "title", "tag")


@query("filtering_stats")
def _(v):
    kept = filtering.filter_by_activity(v.purchases, 40, 30)
    return filtering.filtering_stats(v.purchases, kept, v.items, filtering.align_items(v.items, kept))


@query("clean_text")
def _(v):
    return v.pages.select("page_id", tx.clean_text(F.col("html"), unicode=False).alias("cleaned"))


@query("clean_text_columns")
def _(v):
    cleaned = tx.clean_text_columns(v.items, ["title", "tag", "category", "absent"], unicode=False)
    return cleaned.select("item_id", "title", "tag", "category")


@query("combined_text")
def _(v):
    blanked = v.items.withColumn("tag", F.when(F.col("size") % 2 == 0, F.col("tag"))).withColumn(
        "category", F.when(F.col("size") % 5 == 0, F.lit("  ")).otherwise(F.col("category")))
    return blanked.select("item_id", tx.combined_text(blanked, ["title", "tag", "absent", "category"], " | ").alias("combined"))


@query("rare_tag_grouping")
def _(v):
    coarse = v.items.withColumn("tag", F.concat_ws("-", "tag", "category"))
    return filtering.group_rare(coarse, 14).select("item_id", "tag")


@query("preprocess_summary")
def _(v):
    valid = images.valid_images(images.find_images(v.items, image_listing(v)), 200, 200)
    items, rows, _ = preprocess.preprocess(v.items, v.purchases, valid, ["title", "category"], ["size", "price"], 20, 25, 30)
    return preprocess.summary(items, rows)


@query("strip_html")
def _(v):
    return v.pages.select("page_id", tx.strip_html(F.col("html")).alias("stripped"))


@query("nfkc_text")
def _(v):
    return v.documents.select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("augment_delete")
def _(v):
    return v.documents.select("doc_id", tx.augment_delete(F.col("text"), F.col("doc_id"), 0.2).alias("augmented"))


@query("augment_swap")
def _(v):
    return v.items.select("item_id", tx.augment_swap(F.concat_ws(" ", "title", "tag", "category"), F.col("item_id"), 0.5).alias("augmented"))


@query("augment_swap_documents")
def _(v):
    return v.documents.select("doc_id", tx.augment_swap(F.col("text"), F.col("doc_id"), 0.2).alias("augmented"))


# ---------------------------------------------------------------- encoding and features

@query("encode_users")
def _(v):
    return encoding.fit_labels(v.purchases, "user_id")


@query("encode_items")
def _(v):
    return encoding.fit_labels(v.items, "item_id")


def gappy_items(v: Views) -> DataFrame:
    """Items with some tags missing, as raw data has them."""
    return v.items.withColumn("tag", F.when(F.col("size") != 13, F.col("tag")))


@query("encode_tag")
def _(v):
    return encoding.fit_labels(filtering.fill_tag(gappy_items(v)), "tag")


@query("indexed_interactions")
def _(v):
    users = encoding.fit_labels(v.purchases, "user_id")
    items = encoding.fit_labels(v.items, "item_id")
    rows = encoding.encode(encoding.encode(v.purchases, "user_id", users, "user_idx"), "item_id", items, "item_idx")
    return rows.select("row_id", "user_idx", "item_idx")


@query("decoded_interactions")
def _(v):
    items = encoding.fit_labels(v.items, "item_id")
    indexed = encoding.encode(v.clicks, "item_id", items, "item_idx").select("row_id", "item_idx")
    return encoding.decode(indexed, "item_idx", items, "item_id").select("row_id", "item_id")


NUMERIC = ["size", "price"]


@query("fit_scaler")
def _(v):
    return encoding.fit_scaler(v.items, NUMERIC)


def _scaled(v: Views, method: str) -> DataFrame:
    stats = encoding.fit_scaler(v.items, NUMERIC) if method != "log1p" else None
    return encoding.scale(v.items, NUMERIC, stats, method).select("item_id", *NUMERIC)


QUERIES["scale_standard"] = lambda s, d: plain(_scaled(Views(s, d), "standardization"))
QUERIES["scale_minmax"] = lambda s, d: plain(_scaled(Views(s, d), "min_max"))
QUERIES["scale_log1p"] = lambda s, d: plain(_scaled(Views(s, d), "log1p"))


def messy_items(v: Views) -> DataFrame:
    """Numbers as text, some of it no number."""
    return v.items.withColumn("size", F.when(F.col("size") % 9 == 0, F.lit("n/a")).otherwise(F.col("size").cast("string")))


@query("numeric_feature_vector")
def _(v):
    messy = messy_items(v)
    stats = encoding.fit_scaler(messy, NUMERIC)
    out = features.numeric_vector(messy, NUMERIC, stats, "standardization")
    return out.select("item_id", F.col("numeric")[0].alias("x0"), F.col("numeric")[1].alias("x1"))


@query("item_features")
def _(v):
    known = filtering.fill_tag(gappy_items(v))
    known = known.withColumn("text", tx.combined_text(known, ["title", "tag"]))
    tags = encoding.fit_labels(known, "tag")
    stats = encoding.fit_scaler(known, NUMERIC)
    out = features.item_features(v.items, known, NUMERIC, tags, stats, "min_max")
    return out.select("item_id", F.col("numeric")[0].alias("x0"), F.col("numeric")[1].alias("x1"), "tag_idx", "text")


@query("text_tfidf")
def _(v):
    docs = v.documents.select("doc_id", "text")
    sums = features.text_tfidf(docs, "doc_id", "text", 512, unicode=False).groupBy("doc_id").agg(
        F.count_if(F.col("weight") != 0).alias("terms"), F.sum("tf").alias("words"), F.sum("weight").alias("weight"))
    return docs.select("doc_id").join(sums, "doc_id", "left").fillna(0, ["terms", "words", "weight"])


@query("fused_features")
def _(v):
    numeric = features.numeric_vector(v.items, NUMERIC, None, "log1p").select("item_id", "numeric")
    joined = (v.items.select("item_id").join(numeric, "item_id", "left")
              .join(v.embeddings.select("item_id", "embedding"), "item_id", "left"))
    out = features.fuse(joined, ["numeric", "embedding"])
    return out.select("item_id", F.size("features").alias("width"),
                      F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"),
                      F.col("features")[0].alias("first"))


@query("embedding_cosine")
def _(v):
    anchor = v.embeddings.groupBy("label").agg(F.min_by("embedding", F.col("item_id").cast("bigint")).alias("anchor"))
    both = v.embeddings.join(anchor, "label")
    return both.select("item_id", cosine(as_doubles(F.col("embedding")), as_doubles(F.col("anchor"))).alias("cosine"))


# ---------------------------------------------------------------- ordering and aggregates

@query("topk_per_user")
def _(v):
    best = v.clicks.groupBy("user_id", "item_id").agg(F.round(F.sum("value"), 6).alias("score"))
    return top_k(best, ["user_id"], [F.col("score").desc(), F.col("item_id")], K)


@query("popularity_ranks")
def _(v):
    return novelty.popularity_ranks(filtering.item_popularity(v.purchases))


@query("item_popularity")
def _(v):
    return filtering.item_popularity(v.purchases)


@query("user_activity")
def _(v):
    return v.purchases.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))


@query("user_history")
def _(v):
    return filtering.user_history(v.purchases)


@query("distribution_shift")
def _(v):
    halves = splits.simple_random_split(v.purchases, 0.3)
    month = F.date_trunc("month", F.col("timestamp"))
    part = lambda s: halves.filter(F.col("split") == s)
    out = filtering.distribution_shift(part("train"), part("val"), month)
    return out.withColumn("value", F.date_format("value", "yyyy-MM"))


@query("unseen_candidates")
def _(v):
    data, test = purchase_data(v)
    need = test.select("user_id").distinct().select("user_id", F.lit(50).alias("m"))
    pairs = sampling.take_from_catalog(need, sampling.index_catalog(v.items), data.seen.limit(0), random=True)
    return filtering.drop_seen(pairs.select("user_id", "item_id"), data.history)


@query("attach_stratum")
def _(v):
    joined, _ = splits.attach_stratum(v.purchases, v.items, "tag")
    return joined.select("row_id", "tag")


# ---------------------------------------------------------------- splits

def _keys(v: Views) -> DataFrame:
    """Purchases with what a split looks at."""
    return v.purchases.select("row_id", "user_id", "item_id", "timestamp")


def _temporal_by_tag(v: Views) -> DataFrame:
    return splits.stratified_temporal_split(_keys(v), 0.7, 0.15, 0.15, stratify_by="tag", items=v.items)


def _labels(df: DataFrame) -> DataFrame:
    return df.select("row_id", "split")


@query("split_stratified_column")
def _(v):
    rows, column = splits.attach_stratum(v.purchases, v.items, "tag")
    return _labels(splits.column_stratified_split(rows, 0.7, 0.15, 0.15, column))


@query("split_stratified_temporal")
def _(v):
    return _labels(_temporal_by_tag(v))


@query("split_user")
def _(v):
    return _labels(splits.user_based_split(v.purchases, 0.8, 30))


@query("split_item")
def _(v):
    return _labels(splits.item_based_split(v.purchases, 0.8, 25))


@query("split_per_user")
def _(v):
    return _labels(splits.per_user_split(v.purchases, 0.8, 20))


@query("split_random")
def _(v):
    return _labels(splits.simple_random_split(v.purchases, 0.8))


@query("split_temporal")
def _(v):
    return _labels(splits.temporal_split(v.purchases))


@query("split_leave_one_out")
def _(v):
    return _labels(splits.leave_one_out_split(v.purchases))


@query("split_cold_start")
def _(v):
    return _labels(splits.cold_start_split(_keys(v)))


@query("split_statistics")
def _(v):
    return splits.split_statistics(stored(_temporal_by_tag(v).select("user_id", "item_id", "split")))


@query("training_subsets")
def _(v):
    return splits.training_subsets(v.purchases).select("row_id", "time_bin", "level")


@query("subset_shift")
def _(v):
    subsets = cut(splits.training_subsets(v.clicks).select("timestamp", "level"))
    month = F.date_format("timestamp", "yyyy-MM")
    out = None
    for level in (1, 2, 3):
        gaps = filtering.distribution_shift(subsets, subsets.filter(F.col("level") >= level), month)
        row = gaps.agg(F.max("gap").alias("largest_gap"), (F.sum("gap") / 2).alias("variation")).withColumn("level", F.lit(level))
        out = row if out is None else out.unionByName(row)
    return out


@query("split_job_counts")
def _(v):
    done = split_job.make_splits(v.purchases, v.items, "stratified_by_column", "tag", 20, 25,
                                 train_ratio=0.7, val_ratio=0.15, test_ratio=0.15)
    return done.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("leakage_check")
def _(v):
    return splits.leakage_check(stored(_temporal_by_tag(v).select("user_id", "timestamp", "split")))


# ---------------------------------------------------------------- sampling

@query("negatives_random")
def _(v):
    return sampling.training_negatives(v.purchases, v.items, 1.0)


@query("negatives_popularity")
def _(v):
    return sampling.training_negatives(v.purchases, v.items, 1.0, "popularity")


@query("negatives_popularity_inverse")
def _(v):
    return sampling.training_negatives(v.purchases, v.items, 1.0, "popularity_inverse")


@query("negatives_rejection")
def _(v):
    return sampling.training_negatives(v.clicks, v.items, 2.5).select("user_id", "item_id", "rank")


@query("train_samples")
def _(v):
    return sampling.train_samples(v.purchases, v.items, 0.5)


for _strategy, _suffix in (("random", ""), ("popularity", "_popularity"), ("popularity_inverse", "_popularity_inverse")):
    def _candidates(v, strategy=_strategy):
        _, test = click_data(v)
        return sampling.eval_candidates(test, v.items, 30, strategy)
    query(f"eval_candidates{_suffix}")(_candidates)


# ---------------------------------------------------------------- recommenders

@query("item_similarity")
def _(v):
    return sim.item_similarity(v.purchases)


@query("item_similarity_clicks")
def _(v):
    return sim.item_similarity(v.clicks)


@query("user_similarity")
def _(v):
    return sim.user_similarity(v.clicks)


@query("user_neighbors")
def _(v):
    return nearest(sim.count_matrix(v.clicks), "user_id", "item_id", None, 20)


@query("rec_random")
def _(v):
    data, test = purchase_data(v)
    return rec.recommend_random(data, test.select("user_id").distinct(), K)


@query("rec_popularity")
def _(v):
    return purchase_recs(v)[0]


def _sample_pairs(v: Views, test: DataFrame) -> DataFrame:
    """Test pairs plus one unknown item and one unknown user."""
    pairs = test.select("user_id", "item_id").distinct()
    extra = pairs.agg(F.min("user_id").alias("user_id"), F.min("item_id").alias("item_id"))
    return (pairs.unionByName(extra.select("user_id", F.lit("no-item").alias("item_id")))
            .unionByName(extra.select(F.lit("no-user").alias("user_id"), "item_id")))


@query("score_random")
def _(v):
    data, test = purchase_data(v)
    return rec.score_random(data, _sample_pairs(v, test))


@query("score_popularity")
def _(v):
    data, test = purchase_data(v)
    return rec.score_popularity(data, _sample_pairs(v, test))


def _all_users(v: Views, test: DataFrame) -> DataFrame:
    """Test users and one user nobody knows."""
    users = test.select("user_id").distinct()
    return users.unionByName(users.agg(F.lit("no-user").alias("user_id")))


@query("rec_item_knn")
def _(v):
    data, test = click_data(v)
    return rec.recommend_item_knn(data, _all_users(v, test), K)


@query("rec_item_knn_catalog")
def _(v):
    data, test = click_data(v)
    return rec.recommend_item_knn(data, _all_users(v, test), 120)


@query("score_item_knn")
def _(v):
    data, test = click_data(v)
    return rec.score_item_knn(data, _sample_pairs(v, test))


@query("rec_user_knn")
def _(v):
    data, test = click_data(v)
    return rec.recommend_user_knn(data, _all_users(v, test), K, k_neighbors=20)


@query("score_user_knn")
def _(v):
    data, test = click_data(v)
    return rec.score_user_knn(data, _sample_pairs(v, test), k_neighbors=20)


def _taste(v: Views, history: DataFrame) -> DataFrame:
    """(user_id, vector): mean embedding of the user's history items, summed in the JVM."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    units = v.embeddings.select("item_id", array_to_vector(as_doubles(F.col("embedding"))).alias("_v"))
    # dealt by user first, so that sums of vectors are made where they are used and none is shuffled
    mine = filtering.user_history(history.select("user_id", "item_id").repartition("user_id"))
    return (mine.join(small(units, units.count()), "item_id").groupBy("user_id")
            .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("vector")))


def _item_vectors(v: Views) -> DataFrame:
    return v.embeddings.select("item_id", F.col("embedding").alias("vector"))


@query("rec_embedding_dot")
def _(v):
    data, _ = click_data(v, keep=True)
    return rec.dot_top_k(data, _taste(v, data.history), _item_vectors(v), K)


@query("rec_model")
def _(v):
    """Any numpy model in Arrow batches: here a tanh layer over the item vector with fixed weights."""
    data, test = click_data(v)
    pool = sampling.eval_candidates(test, v.items, 50).select("user_id", "item_id")
    width = 64

    def make():
        weights = np.linspace(-1.0, 1.0, width)
        return lambda x: np.tanh(x @ weights)

    model = scorer.batch_scorer(make, width)

    def score(pairs: DataFrame) -> DataFrame:
        vectors = _item_vectors(v).select("item_id", as_doubles(F.col("vector")).alias("_v"))
        scored = vectors.select("item_id", model(F.col("_v")).alias("score"))
        return pairs.join(scored, "item_id", "left")

    return rec.recommend_model(data, test.select("user_id").distinct(), K, candidates=pool, scorer=score)


@query("score_pairs")
def _(v):
    data, test = click_data(v)
    return rec.score_model(data, _sample_pairs(v, test), rec.dot_scorer(_taste(v, data.history), _item_vectors(v)))


@query("recs_for_users")
def _(v):
    data, _ = purchase_data(v)
    return rec.recommender("popularity")(data, tables.sample_users(v.purchases, 20), k=20, filter_seen=True)


# ---------------------------------------------------------------- accuracy

def _per_user_accuracy(v: Views) -> DataFrame:
    recs, _, test = purchase_recs(v)
    return accuracy.hit_table(recs, test)


@query("precision_at_k")
def _(v):
    return _per_user_accuracy(v).select("user_id", accuracy.precision_at_k(5).alias("precision"))


@query("recall_at_k")
def _(v):
    return _per_user_accuracy(v).select("user_id", accuracy.recall_at_k(K).alias("recall"))


@query("ndcg_list")
def _(v):
    return _per_user_accuracy(v).select("user_id", accuracy.ndcg_list(K).alias("ndcg"))


@query("average_precision")
def _(v):
    return _per_user_accuracy(v).select("user_id", accuracy.average_precision().alias("ap"))


@query("map")
def _(v):
    return accuracy.mean_over_users(_per_user_accuracy(v), map=accuracy.average_precision())


@query("mrr")
def _(v):
    return accuracy.mean_over_users(_per_user_accuracy(v), mrr=accuracy.reciprocal_rank())


@query("hit_rate")
def _(v):
    return accuracy.mean_over_users(_per_user_accuracy(v), hit_rate=accuracy.is_hit())


def _evaluation(name: str, mode: str = "sampled", strategy: str = "random", **options):
    def build(v: Views) -> DataFrame:
        data, test = click_data(v)
        return evaluate.evaluator("retrieval")(data, test, name, k=K, mode=mode, negatives=30, strategy=strategy,
                                               embeddings=v.embeddings, **options)
    return build


query("eval_retrieval_random")(_evaluation("random"))
query("eval_retrieval_popularity")(_evaluation("popularity"))
query("eval_retrieval_item_knn")(_evaluation("item_knn"))
query("eval_retrieval_user_knn")(_evaluation("user_knn", k_neighbors=20))
query("eval_retrieval_catalog")(_evaluation("popularity", "catalog"))
query("eval_retrieval_positives")(_evaluation("popularity", "positives"))


@query("eval_ranking")
def _(v):
    data, test = click_data(v)
    return evaluate.evaluator("ranking")(data, test, "popularity", k=5)


# ---------------------------------------------------------------- novelty and diversity

def _novelty(v: Views) -> DataFrame:
    recs, data, _ = purchase_recs(v)
    ranks = novelty.popularity_ranks(filtering.item_popularity(data.history))
    return novelty.novelty_per_user(novelty.novelty_rows(recs, ranks, data.history))


_NOVELTY = {"self_information": ["avg_self_information"], "iif": ["avg_iif"], "catalog_coverage": ["catalog_coverage"],
            "popularity_stats": ["avg_popularity_rank", "popularity_rank_std", "min_popularity_rank", "max_popularity_rank"],
            "long_tail_share": ["long_tail_percentage"], "personalized_novelty": ["personalized_novelty"]}
for _name, _columns in _NOVELTY.items():
    query(_name)(lambda v, columns=_columns: _novelty(v).select("user_id", *columns))


@query("novelty_per_user")
def _(v):
    recs, data, _ = click_recs(v)
    ranks = novelty.popularity_ranks(filtering.item_popularity(data.history))
    lists = novelty.novelty_per_user(novelty.novelty_rows(recs, ranks, data.history))
    return lists.join(novelty.intra_list_similarity(recs, v.embeddings).select("user_id", "ils"), "user_id", "left")


@query("intra_list_similarity")
def _(v):
    recs, _, _ = click_recs(v)
    return novelty.intra_list_similarity(recs, v.embeddings)


@query("pairwise_diversity_cosine")
def _(v):
    recs, _, _ = click_recs(v)
    return novelty.pairwise_diversity(recs, v.embeddings, "cosine")


@query("pairwise_diversity_euclidean")
def _(v):
    recs, _, _ = click_recs(v)
    return novelty.pairwise_diversity(recs, v.embeddings, "euclidean")


@query("coverage_diversity")
def _(v):
    return novelty.coverage_diversity(purchase_recs(v)[0])


@query("personalization")
def _(v):
    recs, _, test = click_recs(v)
    return novelty.personalization(recs, test)


@query("serendipity")
def _(v):
    data, test = click_data(v)
    users = test.select("user_id").distinct()
    recs = rec.recommend_random(data, users, K, filter_seen=False)
    expected = rec.recommend_popularity(data, users, 20, filter_seen=False)
    return novelty.serendipity(recs, expected, test, users)


@query("temporal_diversity")
def _(v):
    recs, data, _ = purchase_recs(v)
    days = data.history.groupBy("item_id").agg(F.min(F.datediff(F.col("timestamp").cast("date"), F.lit("1970-01-01").cast("date"))).cast("double").alias("time"))
    return novelty.temporal_diversity(recs, days)


@query("satisfaction_proxy")
def _(v):
    recs, data, _ = purchase_recs(v)
    items = v.items
    facts = items.select("item_id", F.explode(F.array(
        F.struct(F.col("tag").alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.col("category").alias("feature"), F.lit(0.5).alias("value")),
        F.struct(F.lit("price").alias("feature"), (F.col("price") / 1000).alias("value")))).alias("f")).select("item_id", "f.*")
    likes = (data.history.join(facts, "item_id").groupBy("user_id", "feature").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("c"))
             .select("user_id", "feature", (F.col("m") * F.col("c")).alias("value")))
    return novelty.satisfaction_proxy(recs, facts, likes)


# ---------------------------------------------------------------- fairness

@query("gini")
def _(v):
    return fairness.gini(filtering.item_popularity(v.purchases), "pop")


@query("demographic_parity")
def _(v):
    recs, _, _ = purchase_recs(v)
    return fairness.demographic_parity(recs, v.users, "group")


def _providers(v: Views) -> DataFrame:
    """Each item's most frequent supplier."""
    counts = v.purchases.groupBy("item_id", "provider").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("item_id").agg(F.max_by("provider", F.struct("c", "provider")).alias("provider"))


@query("provider_exposure")
def _(v):
    return fairness.provider_exposure(purchase_recs(v)[0], _providers(v))


@query("provider_gini")
def _(v):
    return fairness.provider_gini(purchase_recs(v)[0], _providers(v))


# ---------------------------------------------------------------- scorer and losses

@query("fit_scorer")
def _(v):
    """Click scorer on clicks and sampled negatives, judged on held-out pairs."""
    items = v.items
    tags = encoding.fit_labels(items, "tag")
    table = features.item_features(items, items.withColumn("text", F.lit("")), NUMERIC, tags,
                                   encoding.fit_scaler(items, NUMERIC), "standardization")
    samples = sampling.train_samples(v.clicks, items, 0.5).select("user_id", "item_id", F.col("label").cast("double").alias("label"))
    rows = cut(samples.join(table.select("item_id", "numeric", "tag_idx"), "item_id"))
    hashed, vectors = ["user_id", "item_id", "tag_idx"], ["numeric"]
    train, held = scorer.split_samples(rows)
    scored = cut(scorer.apply_scorer(scorer.fit_scorer(train, hashed, vectors, factors=4, iterations=15), held, hashed, vectors))
    return accuracy.binary_metrics(scored).withColumn("auc", accuracy.roc_auc(scored).scalar())


@query("roc_auc")
def _(v):
    scores = v.labelled_scores
    return accuracy.roc_auc(scores.withColumn("score", F.round("score", 2)))


@query("binary_metrics")
def _(v):
    return accuracy.binary_metrics(v.labelled_scores)


@query("bce_loss")
def _(v):
    return losses.bce_loss(v.labelled_scores)


def _paired(v: Views) -> DataFrame:
    """Each vector with a copy whose neighbours are mixed in a little."""
    mixed = F.transform("embedding", lambda x, i: x + F.get(F.col("embedding"), F.pmod(i + 1, F.size("embedding"))) * F.lit(0.5))
    return v.embeddings.select("item_id", F.col("embedding").alias("left"), mixed.alias("right"))


@query("contrastive_alignment")
def _(v):
    return losses.contrastive_alignment(_paired(v), "left", "right", 0.1, 64)


@query("total_loss")
def _(v):
    return losses.total_loss(losses.bce_loss(v.labelled_scores), losses.contrastive_alignment(_paired(v), "left", "right", 0.1, 64))


# ---------------------------------------------------------------- flagship

@query("leave_one_out_popularity")
def _(v):
    """Activity filter, leave-one-out, popular unseen items, accuracy of the held-out item."""
    rows = filtering.filter_by_activity(stored(_keys(v)), 5, 3)
    labelled = stored(splits.leave_one_out_split(rows).select("user_id", "item_id", "split"))
    history = labelled.filter(F.col("split") == "train").drop("split")
    test = labelled.filter(F.col("split") == "test").drop("split")
    data = rec.RecommenderData(rows, v.items, history)
    recs = rec.recommend_popularity(data, test.select("user_id").distinct(), K)
    return accuracy.retrieval_summary(accuracy.retrieval_per_user(recs, test, K))
