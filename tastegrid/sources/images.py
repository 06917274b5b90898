"""Image files as tables: listing, look-up by item, validity and the compression decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.operators.ranking import top_k

EXTENSIONS = (".jpg", ".jpeg", ".png")   # fixed values: accepted endings, first one wins


def _local(path: str) -> Column:
    """One spelling of local paths: the two readers write ``file:/`` and ``file:///``."""
    return F.regexp_replace(path, "^file:/+", "file:/").alias("path")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of every file; the bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(_local("path"), "length")


def decode_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height); files that do not decode have width -1."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(folder)
    return images.select(_local("image.origin"), F.col("image.width").alias("width"),
                         F.col("image.height").alias("height"))


def name_parts(listing: DataFrame) -> DataFrame:
    """Add the item id (file stem) and the ending of each path."""
    name = F.element_at(F.split("path", "/"), -1)
    return (listing.withColumn("item_id", F.regexp_replace(name, r"\.[^.]*$", ""))
            .withColumn("ext", F.regexp_extract(name, r"(\.[^.]*)$", 1)))


def find_images(items: DataFrame, listing: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """The file of each item: the first accepted ending that exists. Items without one drop out."""
    place = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.col("ext"))
    accepted = name_parts(listing).withColumn("_place", place).filter(F.col("_place") > 0)
    mine = accepted.join(items.select("item_id").distinct(), "item_id", "left_semi")
    return top_k(mine, ["item_id"], [F.col("_place"), F.col("path")], 1, "_r").drop("_place", "_r")


def valid_images(found: DataFrame, min_width: int, min_height: int) -> DataFrame:
    """Item ids whose image decodes and is large enough; needs width and height."""
    return found.filter((F.col("width") >= min_width) & (F.col("height") >= min_height)).select("item_id")


def compression_manifest(found: DataFrame, max_kb: float = 500.0, target_edge: int = 1024) -> DataFrame:
    """Which files are too heavy and the size to bring them to, keeping proportions."""
    heavy = F.col("length") / 1024.0 > F.lit(max_kb)
    longest = F.greatest("width", "height")
    shrink = heavy & (longest > target_edge)
    scale = F.lit(float(target_edge)) / longest
    size = lambda c: F.when(shrink, F.floor(F.col(c) * scale)).otherwise(F.col(c)).cast("bigint")
    return found.select("item_id", "path", "length", heavy.alias("compress"),
                        size("width").alias("target_width"), size("height").alias("target_height"))
