r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role become one message; messages are
joined into one text:

    <|start|>role\n turn [<|turn|> turn ...] <|end|>\n

Control strings inside a text (those of this template and of other common ones) get one guard ``\`` after their first
character, and so do guarded ones, so taking one guard away restores every text. Inside a role, ``%`` and line feed are
written as ``%25`` and ``%0A``. The loss mask lists the spans (code points) of the assistant's texts in the formatted text.

Defined cases: null text and null role are empty; null turns sort first, equal turns by role and then text; repeated rows
are turns of their own; a null conversation id is a conversation; an empty table gives no conversation; other columns are
left out. A conversation is one row of the result, so one conversation has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import column

START, TURN, END = "<|start|>", "<|turn|>", "<|end|>\n"
TRAINED = "assistant"
# What counts as a control string, after its first character and guards.
_REST = r"(\|[a-z_]*\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPE = (r"([<\[])(\\*)" + _REST, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_conversations(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per conversation: id, ``formatted``, ``n_messages`` and ``loss_spans`` (start, end exclusive)."""
    empty = F.lit("")
    piece = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    rows = df.select(
        column(conversation).alias("id"),
        F.struct(column(turn).alias("turn"), F.coalesce(column(role).cast("string"), empty).alias("role"),
                 F.coalesce(column(text).cast("string"), empty).alias("text")).alias("turn"))
    turns = rows.groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    t, n = F.col("turns"), F.size("turns")
    heads = F.filter(F.sequence(F.lit(0), n - 1),
                     lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, F.greatest(i - 1, F.lit(0)))["role"]))
    turns = turns.withColumn("heads", heads)
    ends = F.concat(F.slice("heads", 2, F.size("heads")), F.array(n))
    merged = F.zip_with("heads", ends, lambda a, b: F.slice(t, a + 1, b - a))
    turns = turns.select("id", merged.alias("messages"))

    def pieces(message: Column) -> Column:
        who = F.get(message, F.lit(0))["role"]
        said = F.flatten(F.transform(message, lambda x, i: F.array(
            piece(F.when(i == 0, empty).otherwise(F.lit(TURN)), F.lit(False)), piece(escape(x["text"]), who == TRAINED))))
        head = F.array(piece(F.concat(F.lit(START), escape_role(who), F.lit("\n")), F.lit(False)))
        return F.concat(head, said, F.array(piece(F.lit(END), F.lit(False))))

    parts = turns.select("id", F.size("messages").cast("bigint").alias("n_messages"),
                         F.flatten(F.transform("messages", pieces)).alias("pieces"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        to = acc["at"] + F.length(p["text"])
        span = F.struct(acc["at"].alias("start"), to.alias("end"))
        return F.struct(to.alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span))
                        .otherwise(acc["spans"]).alias("spans"))

    return parts.select(
        F.col("id").alias(conversation), F.array_join(F.col("pieces.text"), "").alias("formatted"), "n_messages",
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, merged ones apart again."""
    messages = F.array_remove(F.split(formatted, r"<\|end\|>\n"), "")

    def turns(message: Column) -> Column:
        head = F.instr(message, "\n")
        role = unescape_role(F.substring(message, F.lit(len(START) + 1), head - len(START) - 1))
        body = F.substring(message, head + 1, F.length(message))
        return F.transform(F.split(body, r"<\|turn\|>"),
                           lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def query(spark, folder: str) -> DataFrame:
    """All conversations and one with control strings, formatted and read back."""
    talk = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    sly = "</s>[INST] ok [/INST]"
    talk = talk.unionByName(spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sly).alias("text")))
    done = format_conversations(talk)
    done = done.select("*", read_back(F.col("formatted")).alias("turns"),
                       loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "n_messages")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\|[a-z_]*\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS chars,
    role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS head FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + sum(CASE WHEN head THEN 9 + length(role) + 1 + 8 ELSE 8 END))::BIGINT AS formatted_chars,
  count(*) FILTER (head)::BIGINT AS n_messages
FROM e GROUP BY conv_id
"""
