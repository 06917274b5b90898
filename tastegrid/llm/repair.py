"""Conversation structure repair by a run-length dynamic programme.

Rows of a conversation, by turn, have a role and at most one fault: blank (no character but white space), duplicate (role and
text seen earlier in the conversation) or truncated (last character that is no white space isn't one of ``.!?``). Edits turn
the role initials into ``(s?(ua)+)?`` at least cost: Keep 0, Rerole to user or assistant 2, Delete 3 (a must for blank and
duplicate rows), Insert an empty user or assistant turn anywhere 2; a truncated row that stays adds 1. The audit lists the
edits' initials in order; of equally cheap audits it is the least in ASCII order.

Method: a row's symbol (role initial, fault) is a 4 x 4 min-plus matrix over the states nothing, system, user, assistant of the
pattern. Equal consecutive symbols collapse to runs, and a run advances the cost-to-go through cached binary powers of its
matrix. The audit is unrolled forwards, taking in every state the least letter that keeps to the cost-to-go.

On Spark: all rows are range-partitioned and sorted once by (conversation, turn, role, text), so a huge conversation spreads over
many tasks. A task finishes the conversations that lie wholly inside its range; the first and the last one, and any that
outgrows a piece, are handed on as pieces of bounded size with their matrices. A backward stream over the matrices alone
gives every piece the cost-to-go behind it; a forward stream unrolls the pieces in order. That last stream is sequential per
conversation because its SHA-256 and its audit are, but it holds only one piece and the audit.

Defined cases: null roles and texts are one space; a null turn sorts first and doesn't count for gaps; rows with equal turns
sort by role and text; a null conversation id is a conversation; a role with another initial can't be kept; differences that
leave 64 bits are cut to them; a conversation without rows has zeros, an empty audit and the hash of the empty text; an empty
table gives no rows; repeated rows count as duplicates; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import SPACE_CHARS, column, store

PIECE_ROWS, PIECE_CHARS = 128, 1 << 16
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
EMITS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
UNIT = [[0 if p == q else NEVER for q in range(4)] for p in range(4)]


def times(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Min-plus product."""
    return [[min(NEVER, *(row[k] + b[k][q] for k in range(4))) for q in range(4)] for row in a]


def apply(a: list[list[int]], v: tuple[int, ...]) -> tuple[int, ...]:
    """Cost-to-go before a step, from the cost-to-go after it."""
    return tuple(min(row[q] + v[q] for q in range(4)) for row in a)


def _inserts() -> list[list[int]]:
    """Cheapest insertions between two states."""
    out = [row[:] for row in UNIT]
    for emit in (EMITS["u"], EMITS["a"]):
        for p, q in emit.items():
            out[p][q] = 2
    return times(times(out, out), out)


INSERTS = _inserts()
END = tuple(min(INSERTS[q][NOTHING], INSERTS[q][ASSISTANT]) for q in range(4))  # cost-to-go behind the last row


def symbol(role: str, fault: str) -> str:
    """x: must be deleted; else the role's initial (o: none of the three), in upper case if the text is truncated."""
    if fault in "bd":
        return "x"
    initial = role[:1] if role[:1] in EMITS else "o"
    return initial.upper() if fault == "t" else initial


def options(sign: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, in ASCII order."""
    out = [("D", 3, state)]
    if sign != "x":
        extra = int(sign.isupper())
        kept = EMITS.get(sign.lower(), {}).get(state)
        out += [("K", extra, kept)] if kept is not None else []
        out += [("R", 2 + extra, EMITS[r][state]) for r in "ua" if state in EMITS[r]]
    return out


class Runs:
    """Matrices of symbols with their cached binary powers, and the unrolling of runs."""

    BLOCK = 64

    def __init__(self):
        self.powers: dict[str, list] = {}
        self.letters: dict[tuple, tuple[str, int]] = {}

    def power(self, sign: str, exponent: int) -> list[list[int]]:
        """The symbol's matrix to the power 2 ** exponent."""
        if sign not in self.powers:
            row = [[NEVER] * 4 for _ in range(4)]
            for p in range(4):
                for _, cost, q in options(sign, p):
                    row[p][q] = min(row[p][q], cost)
            self.powers[sign] = [times(INSERTS, row)]
        cached = self.powers[sign]
        while len(cached) <= exponent:
            cached.append(times(cached[-1], cached[-1]))
        return cached[exponent]

    def matrix(self, signs: str) -> list[list[int]]:
        out = UNIT
        for sign, run in groupby(signs):
            length = sum(1 for _ in run)
            for i in range(length.bit_length()):
                if length >> i & 1:
                    out = times(out, self.power(sign, i))
        return out

    def back(self, sign: str, length: int, after: tuple) -> tuple:
        """Cost-to-go before a run, from that after it."""
        for i in range(length.bit_length()):
            if length >> i & 1:
                after = apply(self.power(sign, i), after)
        return after

    def _step(self, sign: str, state: int, here: tuple, after: tuple) -> tuple[str, int]:
        """Letters of one row (its insertions first) and the state behind it."""
        base = min(after)
        memo = sign, state, *(v - base for v in after)
        if memo not in self.letters:
            out, at = "", state
            while True:
                taken = next((o for o in options(sign, at) if o[0] == "D" and o[1] + after[at] == here[at]), None)
                insert = None if taken else next((e[at] for e in (EMITS["u"], EMITS["a"])
                                                  if at in e and 2 + here[e[at]] == here[at]), None)
                if insert is not None:
                    out, at = out + "I", insert
                    continue
                taken = taken or next(o for o in options(sign, at) if o[1] + after[o[2]] == here[at])
                self.letters[memo] = out + taken[0], taken[2]
                break
        return self.letters[memo]

    def unroll(self, signs: str, state: int, after: tuple) -> Iterator[tuple[str, int]]:
        """Per row its letters and the state behind it; memory: the runs, and one block of rows."""
        runs = [(sign, sum(1 for _ in run)) for sign, run in groupby(signs)]
        ends = [after]
        for sign, length in reversed(runs):
            ends.append(self.back(sign, length, ends[-1]))
        ends.reverse()
        for (sign, length), behind in zip(runs, ends[1:]):
            for start in range(0, length, self.BLOCK):
                size = min(self.BLOCK, length - start)
                block = [self.back(sign, length - start - size, behind)]
                for _ in range(size):
                    block.append(apply(self.power(sign, 0), block[-1]))
                for i in range(size, 0, -1):
                    letters, state = self._step(sign, state, block[i], block[i - 1])
                    yield letters, state


class Conversation:
    """One conversation's results, fed piece by piece in order."""

    def __init__(self, runs: Runs):
        self.runs, self.state, self.cost = runs, NOTHING, None
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0
        self.least = self.last_turn = self.initial = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys("bdt", 0)

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def feed(self, turns: list, roles: list[str], texts: list[str], faults: str, after: tuple) -> None:
        for turn, role in zip(turns, roles):
            if turn is not None and turn != self.last_turn:
                self.turns, self.last_turn = self.turns + 1, turn
                self.least = turn if self.least is None else self.least
            self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
        for kind in self.faults:
            self.faults[kind] += faults.count(kind)
        signs = "".join(map(symbol, roles, faults))
        if self.cost is None and signs:
            self.cost = apply(self.runs.matrix(signs), after)[NOTHING]
        state = self.state
        for role, text, (letters, new) in zip(roles, texts, self.runs.unroll(signs, state, after)):
            self._insert(letters[:-1])
            if letters[-1] != "D":
                self._line(role if letters[-1] == "K" else NAMES[new], text)
            self.state = new
            self.audit.append(letters)

    def _insert(self, letters: str) -> None:
        for _ in letters:
            self.state = next(e[self.state] for e in (EMITS["u"], EMITS["a"]) if self.state in e)
            self._line(NAMES[self.state], "")

    def result(self) -> tuple:
        while END[self.state]:
            self._insert("I")
            self.audit.append("I")
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        bound = (1 << 63) - 1
        return (min(gaps, bound), *self.faults.values(), self.illegal, self.cost or 0, "".join(self.audit),
                self.digest.hexdigest())


RESULT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")
PIECE = "turns array<bigint>, roles array<string>, texts array<string>, faults string, matrix array<bigint>"
RESULT_KINDS = [*[pa.int64()] * 6, pa.string(), pa.string()]
PIECE_KINDS = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.int64())]


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped): rows damaged by their key's crc32 modulo 20; dropped rows stay, marked."""
    key = F.concat_ws(":", F.coalesce(column(conv).cast("string"), F.lit(" ")), F.coalesce(column(turn).cast("string"), F.lit(" ")))
    rows = df.select(
        column(conv).alias("conv"), column(turn).cast("bigint").alias("turn"),
        F.coalesce(column(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(column(text).cast("string"), F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    damaged = F.when(F.col("h") <= 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                       damaged.alias("text"), (F.col("h") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """Results per conversation of rows (conv, turn, role, text, dropped); roles and texts aren't null."""
    kind = rows.schema["conv"].dataType.simpleString()
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    print_ = F.sha2(F.concat_ws("\0", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null")),
                                F.length("role").cast("string"), F.col("role"), F.col("text")), 256)
    solid = ~F.col("dropped") & (F.length(F.translate("text", SPACE_CHARS, "")) > 0)
    alone = F.concat(F.lit("-"), F.xxhash64("conv", "turn", "role").cast("string"))  # equal to no print, and no common key
    marked = rows.withColumn("print", F.when(solid, print_).otherwise(alone))
    again = (marked.filter(solid).groupBy("print").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("times"))
             .filter("times > 1").select("print", F.col("first.has").alias("first_has"), F.col("first.turn").alias("first_turn")))
    ordered = [F.col("conv"), F.col("turn"), F.col("role")]  # ascending: nulls first
    placed = (marked.join(again, "print", "left").withColumn("start", F.substring("text", 1, 64))
              .repartitionByRange(*ordered, F.col("start")).sortWithinPartitions(*ordered, F.col("text")))
    stream = placed.select("conv", "turn", "role", "text", "dropped", "first_has", "first_turn").mapInArrow(
        _pieces, f"conv {kind}, part int, no int, {RESULT}, {PIECE}")
    stream = store(stream, "conversations")

    pieces = stream.filter(F.col("part").isNotNull())
    behind = (pieces.select("conv", "part", "no", "matrix").repartition("conv")
              .sortWithinPartitions("conv", F.desc("part"), F.desc("no"))
              .mapInArrow(_backward, f"conv {kind}, part int, no int, matrix array<bigint>"))
    both = pieces.select("conv", "part", "no", *_names(PIECE)).unionByName(behind, allowMissingColumns=True)
    rest = (both.repartition("conv").sortWithinPartitions("conv", "part", "no", F.col("faults").isNotNull())
            .mapInArrow(_forward, f"conv {kind}, {RESULT}"))
    return stream.filter(F.col("part").isNull()).select("conv", *_names(RESULT)).unionByName(rest)


def _batch(key_type: pa.DataType, rows: list[tuple], extra: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    names, kinds = ["conv", *(n for n, _ in extra)], [key_type, *(k for _, k in extra)]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


PLACE_KINDS = [("part", pa.int32()), ("no", pa.int32())]
RESULTS = list(zip(_names(RESULT), RESULT_KINDS))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished conversations of one range, and the pieces of those that may go on in another range or outgrow a piece."""
    part, runs = TaskContext.get().partitionId(), Runs()
    extra = PLACE_KINDS + RESULTS + list(zip(_names(PIECE), PIECE_KINDS))
    empty = (None,) * len(RESULT_KINDS)
    started, conv, first, no, chars, previous, key_type = False, None, True, 0, 0, None, None
    turns, roles, texts, faults, out = [], [], [], [], []

    def flush() -> None:
        nonlocal turns, roles, texts, faults, no, chars
        signs = "".join(map(symbol, roles, faults))
        flat = [x for row in runs.matrix(signs) for x in row]
        out.append((conv, part, no, *empty, turns, roles, texts, "".join(faults), flat))
        turns, roles, texts, faults, no, chars = [], [], [], [], no + 1, 0

    def close(last: bool) -> None:
        nonlocal turns, roles, texts, faults, no, chars
        if first or last or no:
            flush()
        else:
            done = Conversation(runs)
            done.feed(turns, roles, texts, "".join(faults), END)
            out.append((conv, None, None, *done.result(), *[None] * len(PIECE_KINDS)))
        turns, roles, texts, faults, no, chars = [], [], [], [], 0, 0

    for batch in batches:
        key_type = batch.column(0).type
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key, turn, role, text, dropped, first_has, first_turn = row
            if not started or key != conv:
                if started:
                    close(False)
                    first = False
                started, conv, previous = True, key, None
            if dropped:
                continue
            solid = text.strip(SPACE_CHARS)
            if not solid:
                fault = "b"
            elif first_has is not None and ((turn is not None, turn or 0) > (first_has, first_turn or 0)
                                            or previous == (turn, role, text)):
                fault = "d"
            else:
                fault = "-" if solid[-1] in ".!?" else "t"
            previous = turn, role, text
            turns.append(turn)
            roles.append(role)
            texts.append(text)
            faults.append(fault)
            chars += len(text)
            if len(roles) >= PIECE_ROWS or chars >= PIECE_CHARS:
                flush()
        if out:
            yield _batch(key_type, out, extra)
            out = []
    if started:
        close(True)
        yield _batch(key_type, out, extra)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost-to-go behind each piece, from the last piece of a conversation to its first."""
    started, conv, after = False, None, END
    for batch in batches:
        out = []
        for key, part, no, flat in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or key != conv:
                started, conv, after = True, key, END
            out.append((key, part, no, list(after)))
            after = apply([flat[i:i + 4] for i in range(0, 16, 4)], after)
        yield _batch(batch.column(0).type, out, PLACE_KINDS + [("matrix", PIECE_KINDS[-1])])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations unrolled piece by piece; before each piece comes the row with the cost-to-go behind it."""
    runs, conv, current, after, key_type = Runs(), None, None, None, None
    for batch in batches:
        out, key_type = [], batch.column(0).type
        for key, _, _, turns, roles, texts, faults, flat in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or key != conv:
                out += [(conv, *current.result())] if current else []
                conv, current = key, Conversation(runs)
            if faults is None:
                after = tuple(flat)
            else:
                current.feed(turns, roles, texts, faults, after)
        if out:
            yield _batch(key_type, out, RESULTS)
    if current:
        yield _batch(key_type, [(conv, *current.result())], RESULTS)


def query(spark, folder: str) -> DataFrame:
    """All conversations damaged by the rule of their row keys, and repaired."""
    rows = damage(spark.read.parquet(f"{folder}/conversations.parquet"))
    return repair(rows).withColumnRenamed("conv", "conv_id")
