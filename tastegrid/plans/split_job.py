"""Filter, attach the stratum, split, write and report: the split job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tastegrid.operators.filtering import filter_by_activity
from tastegrid.operators.splits import attach_stratum, split, split_statistics
from tastegrid.sources.tables import write_split


def make_splits(interactions: DataFrame, items: DataFrame, strategy: str, stratify_by: str | None = None,
                min_user: int = 5, min_item: int = 3, **arguments) -> DataFrame:
    kept = filter_by_activity(interactions, min_user, min_item)
    if stratify_by:
        kept, stratify_by = attach_stratum(kept, items, stratify_by)
    return split(kept, strategy, stratify_by=stratify_by, **arguments)


def run(interactions: DataFrame, items: DataFrame, out: str, strategy: str, **arguments) -> DataFrame:
    """Write one folder per split and return the split statistics of what was written."""
    if interactions.isEmpty():
        raise ValueError("there are no interactions to split")
    write_split(make_splits(interactions, items, strategy, **arguments), out)
    written = interactions.sparkSession.read.parquet(out)
    if written.isEmpty():
        raise ValueError("no interactions are left after filtering")
    return split_statistics(written)
