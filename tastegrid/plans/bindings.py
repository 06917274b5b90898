"""Recommender views over the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.hashing import u01


class Views:
    """The tables under one folder as interactions, items, users, texts and vectors."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def purchases(self) -> DataFrame:
        lines = self.table("lineitem")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        row_id = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate"), cents)
        return (lines.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .select(row_id.alias("row_id"), F.col("o_custkey").cast("string").alias("user_id"),
                        F.col("l_partkey").cast("string").alias("item_id"), F.col("o_orderdate").alias("timestamp"),
                        F.col("l_suppkey").cast("string").alias("provider")))

    @property
    def clicks(self) -> DataFrame:
        """Every event of the stream, whatever its type."""
        return self.table("events").select(
            F.col("event_id").cast("string").alias("row_id"), F.col("user_id").cast("string").alias("user_id"),
            F.get_json_object("props", "$.k").alias("item_id"), F.col("ts").alias("timestamp"), "value")

    @property
    def items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"),
            F.col("p_brand").alias("tag"), F.col("p_type").alias("category"), F.col("p_size").alias("size"),
            F.col("p_retailprice").alias("price"))

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").cast("string").alias("item_id"), "embedding", "label")

    @property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("group"),
            F.col("c_nationkey").alias("nation"))

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @property
    def labelled_scores(self) -> DataFrame:
        return self.table("labels").select("doc_id", F.col("quality").alias("label"), u01("doc_id").alias("score"))
