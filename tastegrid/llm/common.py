"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.session import checkpoint_dir

# White space between words: blank, and code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column with exactly this name, dots and blanks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key written as text, modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def word_array(text: Column) -> Column:
    """Words of a non-null text."""
    return F.array_remove(F.split(text, SPACE), "")


class Shared:
    """An object broadcast together with its class, so that workers can open it without this package; ``value`` opens it once."""

    def __init__(self, spark, value):
        self._bytes, self._opened = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def __getstate__(self):
        return {"_bytes": self._bytes, "_opened": []}

    @property
    def value(self):
        if not self._opened:
            self._opened.append(pickle.loads(self._bytes.value))
        return self._opened[0]


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: lineage ends here, columns stay prunable."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored() -> int:
    """How many tables ``store`` holds: a mark for ``finish``."""
    return len(_written)


def finish(df: DataFrame, name: str, mark: int) -> DataFrame:
    """``df`` stored, and every table stored since the mark deleted: nothing reads them any more."""
    out = store(df, name)
    kept = _written.pop()
    _delete(_written[mark:])
    _written[mark:] = [kept]
    return out


def _delete(tables: list[tuple]) -> None:
    for spark, path in tables:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    """Delete what ``store`` wrote, if the session still lives when the program ends."""
    try:
        _delete(_written)
    except Exception:  # the gateway is gone: the folder is the cluster's to clear
        return


_written: list[tuple] = []
atexit.register(_clean)
