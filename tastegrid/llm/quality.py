"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are applied to the bits afterwards.

``assess`` adds one struct with the measurements and the failure bits. ``verdict`` applies a versioned policy (a set of
rules that reject) to the stored bits, so a new policy never reads a text again. ``ablations`` finds by bitwise
aggregation what each rule of a policy rejects, alone and together with others.

Defined cases: a null text has no words and fails ``few_words``; an empty table gives an empty ledger; repeated rows are
judged one by one; the input's other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import SPACE_CHARS, column, fresh, word_array

# The rules, by bit.
RULES = ("few_words", "repeated_windows", "symbols", "capitals", "exclamations", "duplicate_lines", "word_length")
BASE = ("few_words", "repeated_windows")
# The rules that reject, by version of the policy.
POLICIES = {"v1": BASE, "v2": RULES}
PRODUCTION = "v2"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals",
            "n_exclamations")


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _failures(m: dict[str, Column]) -> dict[str, Column]:
    """Each rule as a condition on the measurements, in whole numbers."""
    return {
        "few_words": m["n_words"] < 50,
        "repeated_windows": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "capitals": 100 * m["n_capitals"] > 40 * m["word_chars"],
        "exclamations": 4 * m["n_exclamations"] > m["n_words"],
        "duplicate_lines": 100 * m["n_dup_lines"] > 50 * m["n_lines"],
        "word_length": (2 * m["word_chars"] < 5 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"]),
    }


def _repeated(words: Column, windows: Column) -> Column:
    """Word positions inside a 3-word window that the text holds twice or more.

    Windows are sorted with their positions, so equal ones stand side by side; texts without a repeat skip the sort.
    """
    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        left = F.slice(pairs, 1, F.size(pairs) - 1)
        right = F.slice(pairs, 2, F.size(pairs) - 1)
        both = F.zip_with(left, right, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
        starts = F.array_distinct(F.flatten(F.filter(both, lambda p: p.isNotNull())))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    # A one-row transform binds the sorted array once.
    once = F.get(F.transform(F.array(ordered), covered), F.lit(0))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(once)


def assess(df: DataFrame, text: str = "text", into: str = "quality") -> tuple[DataFrame, str]:
    """``df`` with one more struct column: the measurements (bigint) and ``failed_bits`` (int).

    Returns the frame and the name the struct got, which differs from ``into`` where the input has that column.
    """
    parts, name = fresh(df, "__parts"), fresh(df, into)
    whole = F.coalesce(column(text).cast("string"), F.lit(""))
    out = df.withColumn(parts, F.struct(whole.alias("text"), word_array(whole).alias("words")))
    words, whole = F.col(parts)["words"], F.col(parts)["text"]
    size = F.size(words)
    windows = F.when(size < 3, F.array().cast("array<string>")).otherwise(
        F.transform(F.arrays_zip(F.slice(words, 1, size - 2).alias("a"), F.slice(words, 2, size - 2).alias("b"),
                                 F.slice(words, 3, size - 2).alias("c")),
                    lambda w: F.concat_ws(" ", w["a"], w["b"], w["c"])))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0)
    out = out.withColumn(parts, F.struct(whole.alias("text"), words.alias("words"), windows.alias("windows"),
                                         lines.alias("lines")))
    part = F.col(parts)
    measured = {
        "n_words": F.size(part["words"]),
        "word_chars": F.length(F.translate(part["text"], SPACE_CHARS, "")),
        "n_symbols": _count_of(part["text"], SYMBOLS),
        "n_dup_lines": F.size(part["lines"]) - F.size(F.array_distinct(part["lines"])),
        "n_repeat_words": _repeated(part["words"], part["windows"]),
        "n_lines": F.size(part["lines"]),
        "n_capitals": F.length(part["text"]) - F.length(F.regexp_replace(part["text"], "[A-Z]+", "")),
        "n_exclamations": _count_of(part["text"], "!"),
    }
    out = out.withColumn(parts, F.struct(*[c.cast("bigint").alias(m) for m, c in measured.items()]))
    failures = _failures({m: F.col(parts)[m] for m in MEASURES})
    bits = reduce(lambda a, b: a.bitwiseOR(b),
                  [F.when(failures[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)])
    kept = [F.col(parts)[m].alias(m) for m in MEASURES]
    return out.withColumn(name, F.struct(*kept, bits.alias("failed_bits"))).drop(parts), name


def verdict(bits: Column, policy: str = PRODUCTION) -> Column:
    """True where no rejecting rule of the policy failed."""
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, the measurements and the failure bits."""
    out, name = assess(df.select(column(key), column(text)), text)
    return out.select(column(key), *[F.col(name)[m].alias(m) for m in (*MEASURES, "failed_bits")])


def keep(df: DataFrame, text: str = "text", policy: str = PRODUCTION) -> DataFrame:
    """The rows that the policy keeps, with their own columns only.

    The row number keeps the optimiser from moving the filter below the measurements, where it would repeat them for each
    of their uses.
    """
    out, name = assess(df, text)
    row = fresh(out, "__row")
    out = out.withColumn(row, F.monotonically_increasing_id())
    kept = verdict(F.col(name)["failed_bits"], policy) & (F.col(row) >= 0)
    return out.filter(kept).select(*[column(c) for c in df.columns])


def ablations(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows only it rejects, and the rules that fail along with it.

    Rows are first counted by their bits, so at most 2 ** len(RULES) rows are expanded by rule.
    """
    active = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy])))
    counts = entries.groupBy(active.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit"))
                                for r in POLICIES[policy]]))
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return counts.select("bits", "n", rules.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.bit_or(F.when(failed, F.col("bits"))), F.lit(0)).alias("fails_with"))


def query(spark, folder: str) -> DataFrame:
    """The production policy over all documents."""
    entries = ledger(spark.read.parquet(f"{folder}/documents.parquet"))
    base = verdict(F.col("failed_bits"), "v1")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (~base).alias("base_failed"), verdict(F.col("failed_bits")).alias("kept"), "failed_bits")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines
      FROM t),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
s AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
d AS (SELECT doc_id, pos, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS dup FROM s),
c AS (SELECT doc_id, pos, dup OR coalesce(lag(dup) OVER o, false) OR coalesce(lag(dup, 2) OVER o, false) AS hit
      FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN 100 * n_capitals > 40 * word_chars THEN 8 ELSE 0 END
        + CASE WHEN 4 * n_exclamations > n_words THEN 16 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
        + CASE WHEN 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words THEN 64 ELSE 0 END AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  failed_bits = 0 AS kept, failed_bits::INTEGER AS failed_bits FROM b
"""


def ablation_query(spark, folder: str) -> DataFrame:
    """What each rule of the production policy does over all documents."""
    return ablations(ledger(spark.read.parquet(f"{folder}/documents.parquet")))


ABLATIONS = ORACLE.rsplit("SELECT doc_id", 1)[0] + f"""
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only,
  coalesce(bit_or(failed_bits) FILTER (failed_bits & bit <> 0), 0)::INTEGER AS fails_with
FROM (VALUES {", ".join(f"('{r}', {1 << RULES.index(r)})" for r in POLICIES[PRODUCTION])}) v(rule, bit), b GROUP BY rule
"""
