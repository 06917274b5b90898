"""Fitted state and feature tables kept on storage, fitted or built once and then reused."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def fit_or_load(spark: SparkSession, path: str, fit: Callable[[], DataFrame]) -> DataFrame:
    """The state stored at ``path``; fitted and stored first when there is none."""
    stored = read_if_present(spark, path)
    if stored is None:
        fit().write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
    return stored


class PartedTable:
    """A table of parquet folders under one path, of which the newest manifest names those that count.

    Rows are written to a folder of their own first and count from the moment that the next manifest exists. Creating that
    file either succeeds or finds it there already, so of several writers one wins a version and the others see it; what a
    killed run has written is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, list[str]]:
        """Number of the newest manifest (0: none) and the folders it names."""
        where = self._hadoop.Path(f"{self.path}/manifest")
        if not self._files.exists(where):
            return 0, []
        numbers = [int(f.getPath().getName()) for f in self._files.listStatus(where) if f.getPath().getName().isdigit()]
        if not numbers:
            return 0, []
        names = self.spark.read.text(f"{self.path}/manifest/{max(numbers)}").collect()  # one line per append
        return max(numbers), [r["value"] for r in names]

    def read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/parts/{f}" for f in folders]) if folders else None

    def stage(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/parts/{folder}")
        return folder

    def commit(self, version: int, folders: list[str]) -> bool:
        """Make ``version`` the newest one; False if another writer has done so."""
        here, done = (self._hadoop.Path(f"{self.path}/manifest/{n}") for n in (f"_{uuid.uuid4().hex}", version))
        out = self._files.create(here, False)
        out.write(bytearray("\n".join(folders).encode()))
        out.close()
        won = not self._files.exists(done) and self._files.rename(here, done)
        if not won:
            self._files.delete(here, False)
        return won


def materialize_features(items: DataFrame, build: Callable[[DataFrame], DataFrame], path: str,
                         force: bool = False, max_items: int | None = None) -> DataFrame:
    """Append feature rows for items the table at ``path`` lacks; ``force`` replaces all of them. Items are distinct.

    A run that ends early leaves the table as it was. A run that loses a version to another one keeps what it has built, leaves
    out the items that the other has brought, and tries the next version.
    """
    table = PartedTable(items.sparkSession, path)
    wanted = items.orderBy("item_id").limit(max_items) if max_items is not None else items
    version, folders = table.version()
    stored = None if force else table.read(folders)
    missing = wanted if stored is None else wanted.join(stored.select("item_id"), "item_id", "left_anti")
    staged = table.stage(build(missing))
    while not table.commit(version + 1, [staged] if force else [*folders, staged]):
        version, folders = table.version()
        if not force:
            rest = table.read([staged]).join(table.read(folders).select("item_id"), "item_id", "left_anti")
            staged = table.stage(rest)
    return table.read(table.version()[1])
