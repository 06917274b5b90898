"""Per-item feature rows and concatenated feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.hashing import hex_number
from tastegrid.functions.numeric import to_number
from tastegrid.functions.text import clean_text, words
from tastegrid.functions.vectors import as_doubles
from tastegrid.operators.encoding import encode, scale


def numeric_vector(df: DataFrame, columns: list[str], stats: DataFrame | None = None,
                   method: str = "none", name: str = "numeric") -> DataFrame:
    """Add an array of the (scaled) numeric columns; the columns themselves are kept as they are."""
    copies = {f"_x_{c}": to_number(F.col(c)) for c in columns}
    out = df.withColumns(copies)
    if method in ("standardization", "min_max") and stats is not None:
        renamed = stats.withColumn("column", F.concat(F.lit("_x_"), F.col("column")))
        out = scale(out, list(copies), renamed, method)
    elif method == "log1p":
        out = scale(out, list(copies), None, method)
    return out.withColumn(name, F.array(*copies)).drop(*copies)


def item_features(catalog: DataFrame, items: DataFrame, columns: list[str], tags: DataFrame,
                  stats: DataFrame | None = None, method: str = "none") -> DataFrame:
    """One row per catalog item: numeric array, tag index and text; zeros where metadata is missing."""
    known = encode(numeric_vector(items, columns, stats, method), "tag", tags, "tag_idx", unknown="null")
    known = known.select("item_id", "numeric", "tag_idx", "text")
    return (catalog.select("item_id").join(known, "item_id", "left")
            .select("item_id",
                    F.coalesce("numeric", F.array_repeat(F.lit(0.0), len(columns))).alias("numeric"),
                    F.coalesce("tag_idx", F.lit(0)).cast("bigint").alias("tag_idx"),
                    F.coalesce("text", F.lit("")).alias("text")))


def fuse(df: DataFrame, blocks: list[str], name: str = "features") -> DataFrame:
    """Concatenate the array blocks a row has; rows without any block are dropped."""
    empty = F.array().cast("array<double>")
    present = F.coalesce(*[F.when(F.col(b).isNotNull(), F.lit(1)) for b in blocks])
    return (df.filter(present.isNotNull())
            .withColumn(name, F.concat(*[F.coalesce(as_doubles(F.col(b)), empty) for b in blocks])))


def text_tfidf(df: DataFrame, key: str, text: str, dims: int = 1024, unicode: bool = True) -> DataFrame:
    """Hashed TF-IDF of the cleaned texts in sparse form: (key, bucket, tf, weight), one row per bucket that a text has.

    A word's bucket is its md5 modulo ``dims``, the weight tf * ln((texts + 1) / (texts with the bucket + 1)). Texts without
    a word have no rows; keys are distinct. Counts are combined where a text is read, before anything is shuffled.
    """
    found = df.select(F.col(key).alias("key"), F.explode(words(clean_text(F.col(text), unicode=unicode))).alias("word"))
    bucket = F.pmod(hex_number(F.md5(F.col("word")), 1, 8), F.lit(dims)).alias("bucket")
    counts = found.select("key", bucket).groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("tf"))
    texts = df.agg(F.count(F.lit(1))).scalar()
    spread = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("_df"))  # dims rows at most
    idf = F.log((texts + 1) / (F.col("_df") + 1))
    return (counts.join(spread, "bucket")
            .select(F.col("key").alias(key), "bucket", "tf", (F.col("tf") * idf).alias("weight")))
