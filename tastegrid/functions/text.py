"""Text cleaning expressions; only NFKC leaves the JVM, as one Arrow batch at a time."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tastegrid.functions.hashing import below, u01


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<.*?>", "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def collapse_whitespace(text: Column) -> Column:
    """Runs of any Unicode white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def clean_text(text: Column, html: bool = True, unicode: bool = True, lower: bool = True) -> Column:
    """HTML strip, NFKC, lower case, white space, in that order; null becomes ''."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    if html:
        out = strip_html(out)
    if unicode:
        out = nfkc(out)
    if lower:
        out = F.lower(out)
    return collapse_whitespace(out)


def clean_text_columns(df: DataFrame, columns: list[str], **switches) -> DataFrame:
    """Clean each listed column that the table has."""
    return df.withColumns({c: clean_text(F.col(c), **switches) for c in columns if c in df.columns})


def combined_text(df: DataFrame, columns: list[str], separator: str = " ") -> Column:
    """Trimmed, non-empty fields of the listed columns joined by the separator."""
    fields = [F.trim(F.col(c).cast("string")) for c in columns if c in df.columns]
    if not fields:
        return F.lit("")
    return F.array_join(F.filter(F.array(*fields), lambda x: x.isNotNull() & (x != "")), separator)


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def augment_delete(text: Column, key: Column, prob: float = 0.1, seed: int = 42) -> Column:
    """Drop each word with the given probability."""
    kept = F.filter(words(text), lambda w, i: u01(key, i, seed=seed) > F.lit(float(prob)))
    return F.array_join(kept, " ")


def augment_swap(text: Column, key: Column, prob: float = 0.1, seed: int = 42) -> Column:
    """One pass of neighbour swaps over the changing list, so that a word may travel right.

    A word is held back while its right neighbours swap with it. So the list falls into runs, one from each word that didn't
    swap to the next such word, and every run is turned left by one: the work is linear in the words, however long the text.
    """
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # evaluated once, not once per element of the body
    stays = lambda i: (i == 0) | ~below(prob, key, i - 1, seed=seed)

    def turned(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), stays)
        run = lambda first, after: F.concat(F.slice(t, first + 2, after - first - 1), F.slice(t, first + 1, F.lit(1)))
        return bound(starts, lambda s: F.flatten(F.transform(s, lambda first, i: run(first, F.coalesce(F.get(s, i + 1), F.size(t))))))

    return F.coalesce(bound(words(text), lambda t: F.when(F.size(t) > 0, F.array_join(turned(t), " "))), F.lit(""))
