"""Language-model scoring with a hidden Markov model over words.

Words of all training documents are counted. The ``HEAD`` most frequent words (seen ``HEAD_COUNT`` times or more, of
``HEAD_BYTES`` bytes at most) are symbols of their own, every other word belongs to one of ``TAILS`` classes by its ending, and the end of a text is one more symbol. A hidden Markov
model with ``STATES`` states generates the symbols; a word is drawn from its class by its add-0.5 share of the class's count.
So the probability of a text is that of its symbols times those of its rarer words in their classes.

Baum-Welch: every partition runs the scaled forward-backward recursion over the windows of its training texts and emits
expected counts; Spark sums them; the driver turns sums of fixed size (symbols x states) into the next parameters. All
training documents take part in each pass, and in the starting point: their shares of letters are cut along the principal axes of all of
them (moments of fixed size are counted with the words), and a state starts with the symbols of one of these groups of texts.
Scoring runs the scaled forward recursion over each whole text, so the likelihood is exact. Rarer words are looked up by a
join of (text, word) pairs with the counts; words that aren't rare don't take part in it, so no key of that join is hot.

Defined cases: a null or blank text is the end alone; repeated rows are scored each and count each in training; without any
training document every count is zero and the model is uniform; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import Shared, column, finish, remainder, store, stored

HEAD, TAILS, STATES = 32_768, 1_024, 8
PASSES, WINDOW, LANES = 2, 256, 512
LETTERS, AXES = 64, 3     # kinds of bytes whose shares describe a text; 2 ** AXES groups of texts, one for each state
STEPS = 256               # shares are rounded, so that their sums are exact and don't depend on the order
HEAD_BYTES, HEAD_COUNT = 64, 5
END = b""
STORED = "<u2"            # HEAD + TAILS + 1 symbols
FLUSH = 400_000
SMOOTH = 50.0  # pseudo-counts of the overall symbol shares in each state


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_classes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, [w[-3:] for w in words]), np.int64, len(words)) % TAILS


class Symbols:
    """Numbers of words: frequent ones, classes of the others, the end."""

    def __init__(self, head: list[bytes]):
        self.of = {w: i for i, w in enumerate(head)}
        self.size = len(head) + TAILS + 1
        self.end = self.size - 1
        self.first_tail = len(head)

    def sequence(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Symbols of the words and the end, and the words that aren't frequent."""
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.of.get, words, repeat(-1)), np.int32, len(words))
        out[-1] = self.end
        rare = np.flatnonzero(out < 0)
        tail = [words[i] for i in rare.tolist()]
        out[rare] = self.first_tail + tail_classes(tail)
        return out, tail


def letters_of(texts: list[str | None]) -> np.ndarray:
    """One row per text: roots of its shares of letters and other bytes, in whole steps; blank texts have none."""
    out = np.zeros((len(texts), LETTERS))
    for row, text in zip(out, texts):
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        row[:] = np.bincount((b & 31) | (b >> 7 << 5), minlength=LETTERS)
    out[:, 0] -= np.array([(text or "").count(" ") for text in texts])
    return np.rint(STEPS * np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)))


def moment(i: int, j: int) -> bytes:
    """Key of a sum among the words: no word has a space."""
    return b" %d %d" % (i, j)


def axes_of(moments: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of the texts' letters from the sums over all of them; the first letter column is their number."""
    sums = np.array([[moments.get(moment(i, j), 0) for j in range(LETTERS + 1)] for i in range(LETTERS + 1)], float)
    n = max(sums[0, 0], 1.0)
    mean = sums[0, 1:] / n
    axes = np.linalg.eigh(sums[1:, 1:] / n - np.outer(mean, mean))[1][:, ::-1][:, :AXES]
    return mean, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(AXES)])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a partition's texts, ends included, in parts of bounded size; and the moments of the texts' letters."""
    counts: Counter = Counter()
    moments = np.zeros((LETTERS + 1, LETTERS + 1), np.int64)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                         names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for x in texts:
            counts.update(words_of(x))
            counts[END] += 1
            if len(counts) >= FLUSH:
                yield flush()
        letters = np.hstack([np.ones((len(texts), 1)), letters_of(texts)])
        moments += (letters.T @ letters).astype(np.int64)
    counts.update({moment(i, j): int(moments[i, j]) for i, j in zip(*np.nonzero(moments))})
    if counts:
        yield flush()


class Model:
    """Start, transition and emission probabilities; ``emit`` has one row per symbol and a last one for padding."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray):
        self.start, self.move, self.share = start, move, share
        self.emit = np.vstack([emit, np.ones(len(start))])

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each whole sequence; none is empty."""
        out = np.zeros(len(sequences))
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        for at in range(0, len(order), LANES):
            lane = order[at:at + LANES]
            lengths = np.array([len(sequences[i]) for i in lane])
            flat = np.concatenate([sequences[i] for i in lane])
            begins = np.cumsum(lengths) - lengths
            alive = np.searchsorted(-lengths, -np.arange(lengths[0]))  # sequences longer than t, for each t
            alpha = np.tile(self.start, (len(lane), 1))
            total = np.zeros(len(lane))
            for t in range(int(lengths[0])):
                n = alive[t]
                part = (alpha[:n] @ self.move if t else alpha[:n]) * self.emit[flat[begins[:n] + t]]
                scale = part.sum(axis=1)
                alpha[:n] = part / scale[:, None]
                total[:n] += np.log(scale)
            out[lane] = total
        return out

    def expected(self, windows: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (start, move, emit) of windows, one per column, padded with -1; ``fresh``: a text starts here."""
        steps, lanes = windows.shape
        e = self.emit[windows]
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, lanes))
        part = np.where(fresh[:, None], self.start, self.share) * e[0]
        for t in range(steps):
            if t:
                part = (alpha[t - 1] @ self.move) * e[t]
            scale[t] = part.sum(axis=1)
            alpha[t] = part / scale[t][:, None]
        ahead = np.zeros_like(e)
        for t in range(steps - 1, 0, -1):
            ahead[t] = e[t] * beta[t] / scale[t][:, None]
            beta[t - 1] = ahead[t] @ self.move.T
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        real = windows >= 0
        ahead *= real[:, :, None]
        k = len(self.start)
        move = self.move * (alpha[:-1].reshape(-1, k).T @ ahead[1:].reshape(-1, k))
        seen = windows[real]
        weights = gamma[real]
        emit = np.stack([np.bincount(seen, weights[:, i], len(self.emit) - 1) for i in range(k)], axis=1)
        return gamma[0][fresh].sum(axis=0), move, emit


def _windows(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    counts = [math.ceil(len(s) / WINDOW) for s in sequences]
    out = np.full((sum(counts), WINDOW), -1, np.int32)
    fresh = np.zeros(len(out), bool)
    at = 0
    for s, n in zip(sequences, counts):
        flat = out[at:at + n].reshape(-1)
        flat[:len(s)] = s
        fresh[at] = True
        at += n
    lengths = (out >= 0).sum(axis=1)
    order = np.argsort(lengths, kind="stable")  # windows of like length stand together
    return out[order], fresh[order]


def _numbered(symbols):
    """Per text: its symbols, and the other words with how often they occur; the first two columns pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = symbols.value
        for batch in batches:
            sequences, offsets, words, times = [], [0], [], []
            for x in batch.column(2).to_pylist():
                ids, tail = names.sequence(words_of(x))
                sequences.append(ids.astype(STORED).tobytes())
                rare = Counter(tail)
                words += rare
                times += rare.values()
                offsets.append(len(words))
            tails = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(words, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sequences, pa.binary()), tails],
                                             names=["key", "train", "symbols", "tail"])
    return run


def _expect(model):
    """Partition-wise expected counts: one row per symbol that occurred, and rows -1 (start) and -2 - k (moves from k)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = model.value
        k = len(hmm.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(hmm.emit) - 1, k))
        pending: list[np.ndarray] = []
        held = 0

        def work() -> None:
            nonlocal start, move, emit, held
            windows, fresh = _windows(pending)
            for at in range(0, len(windows), LANES):
                part = windows[at:at + LANES]
                steps = int((part >= 0).sum(axis=1).max())
                got = hmm.expected(part[:, :steps].T, fresh[at:at + LANES])
                start, move, emit = start + got[0], move + got[1], emit + got[2]
            pending.clear()
            held = 0

        for batch in batches:
            for x in batch.column(0).to_pylist():
                pending.append(np.frombuffer(x, STORED))
                held += len(pending[-1])
                if held >= 4 * WINDOW * LANES:
                    work()
        if pending:
            work()
        used = np.flatnonzero(emit.any(axis=1))
        rows = np.vstack([start[None], move, emit[used]])
        ids = np.concatenate([[-1], -2 - np.arange(k), used])
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at:at + 10_000]), *[pa.array(np.ascontiguousarray(c)) for c in rows[at:at + 10_000].T]],
                names=["symbol", *[f"s{i}" for i in range(k)]])
    return run


def _grouped(symbols, axes):
    """Partition-wise symbol counts of the groups of texts: (symbol, s0, s1, ...)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (mean, directions) = symbols.value, axes.value
        counts = np.zeros(names.size * STATES)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not texts:
                continue
            group = ((letters_of(texts) - mean) @ directions > 0) @ (1 << np.arange(AXES))
            ids = [names.sequence(words_of(x))[0] for x in texts]
            flat = np.concatenate(ids) * np.int64(STATES) + np.repeat(group, [len(i) for i in ids])
            counts += np.bincount(flat, minlength=len(counts))
        emit = counts.reshape(-1, STATES)
        used = np.flatnonzero(emit.any(axis=1))
        for at in range(0, len(used), 10_000):
            part = used[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(np.ascontiguousarray(c)) for c in emit[part].T]],
                                             names=["symbol", *[f"s{i}" for i in range(STATES)]])
    return run


def _start(rows: list, size: int, share: np.ndarray) -> Model:
    """Parameters from the summed symbol counts of the groups: one state each, which mostly stays."""
    emit = _maximised(rows, size, share).emit[:-1]
    move = np.full((STATES, STATES), 0.02 / (STATES - 1))
    np.fill_diagonal(move, 0.98)
    even = np.full(STATES, 1 / STATES)
    return Model(even, move, emit, even)


def _maximised(rows: list, size: int, share: np.ndarray) -> Model:
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((size, STATES))
    for r in rows:
        values = np.array(r[1:])
        if r[0] == -1:
            start = values
        elif r[0] < -1:
            move[-2 - r[0]] = values
        else:
            emit[r[0]] = values
    held = emit.sum(axis=0)
    normal = lambda x: (x + 1e-3) / (x + 1e-3).sum(axis=-1, keepdims=True)
    return Model(normal(start), normal(move), (emit + SMOOTH * share[:, None]) / (held + SMOOTH), normal(held))


def score(df: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) per row; ``train`` is the condition of training rows."""
    spark = df.sparkSession
    mark = stored()
    whole = column(text).cast("string").alias("text")
    training = df.filter(train).select(whole)
    counts = training.mapInArrow(count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = store(counts, "words")
    moments = {bytes(r["word"]): r["n"] for r in counts.filter(F.substring("word", 1, 1) == F.lit(b" ")).collect()}  # of fixed number
    counts = counts.filter((F.length("word") == 0) | (F.substring("word", 1, 1) != F.lit(b" ")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    eligible = counts.filter(F.length("word").between(1, HEAD_BYTES) & (F.col("n") >= HEAD_COUNT))
    least, room = 0, HEAD  # the smallest count such that HEAD words at most have it or a larger one
    for r in eligible.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(HEAD).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    top = eligible.filter(F.col("n") >= least).collect() if least else []  # at most HEAD words of HEAD_BYTES bytes
    top = sorted(top, key=lambda r: (-r["n"], bytes(r["word"])))
    head = [bytes(r["word"]) for r in top]
    symbols = Symbols(head)
    ends = counts.filter(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    names = spark.createDataFrame([(w,) for w in head], "word binary")
    class_of = F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")) % TAILS
    tails = counts.filter(F.length("word") > 0).join(F.broadcast(names), "word", "left_anti")
    tails = store(tails.withColumn("class", class_of.cast("int")), "tails")
    sizes = {r["class"]: (r["c"], r["v"]) for r in
             tails.groupBy("class").agg(F.sum("n").alias("c"), F.count("*").alias("v")).collect()}  # TAILS rows at most

    share = np.zeros(symbols.size)
    share[:len(head)] = [r["n"] for r in top]
    for c, (n, _) in sizes.items():
        share[symbols.first_tail + c] = n
    share[symbols.end] = ends
    share = (share + 0.5) / (share + 0.5).sum()

    shared = Shared(spark, symbols)
    states = ", ".join(f"s{i} double" for i in range(STATES))

    def summed(texts: DataFrame, run) -> list:  # symbols + states + 1 rows at most
        parts = texts.mapInArrow(run, f"symbol bigint, {states}")
        return parts.groupBy("symbol").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(STATES)]).collect()

    # words are looked up once: every further step takes the stored numbers
    rows = df.select(column(key).alias("key"), train.alias("train"), whole)
    kind = rows.schema["key"].dataType.simpleString()
    numbered = rows.mapInArrow(_numbered(shared), f"key {kind}, train boolean, symbols binary, tail array<struct<word:binary,n:bigint>>")
    numbered = store(numbered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    sequences = numbered.filter("train").select("symbols")
    model = _start(summed(training, _grouped(shared, Shared(spark, axes_of(moments)))), symbols.size, share)
    for _ in range(PASSES):
        model = _maximised(summed(sequences, _expect(Shared(spark, model))), symbols.size, share)

    base = {"n": np.array([r["n"] for r in top], float), "total": total + 0.5 * (distinct + 1), "ends": ends}
    done = numbered.select("key", "row", "symbols").mapInArrow(
        _score(Shared(spark, model), Shared(spark, base)),
        f"key {kind}, row bigint, n_tokens bigint, n_known bigint, base double, score double")

    held = spark.createDataFrame([(c, int(n), int(v)) for c, (n, v) in sizes.items()] or [(-1, 0, 0)],
                                 "class int, c bigint, v bigint")
    asked = numbered.select("row", F.explode("tail").alias("t")).select("row", "t.word", F.col("t.n").alias("times"))
    found = asked.join(tails.select("word", "n"), "word", "left").withColumn("class", class_of.cast("int"))
    found = found.join(F.broadcast(held), "class", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    inside = F.log10((none("n") + 0.5) / (none("c") + 0.5 * (none("v") + 1)))
    overall = F.log10((none("n") + 0.5) / F.lit(float(base["total"])))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * overall).alias("base_tail"), F.sum(F.col("times") * inside).alias("score_tail"))
    out = done.join(sums, "row", "left")
    out = out.select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + none("more")).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"), (F.col("base") + none("base_tail")).alias("base_score"),
        (F.col("score") + none("score_tail")).alias("score"))
    return finish(out, "scores", mark)


def _score(model, base):
    """Per text: what the frequent words and the end add to the base score, and the model's likelihood of its symbols."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, counts = model.value, base.value
        head, end = len(counts["n"]), len(hmm.emit) - 2  # the last row of ``emit`` is for padding
        logs = np.zeros(end + 1)
        logs[:head] = np.log10((counts["n"] + 0.5) / counts["total"])
        logs[end] = math.log10((counts["ends"] + 0.5) / counts["total"])
        frequent = np.zeros(end + 1, np.int64)
        frequent[:head] = 1
        frequent[end] = counts["ends"] > 0
        for batch in batches:
            sequences = [np.frombuffer(x, STORED) for x in batch.column(2).to_pylist()]
            likelihood = hmm.forward(sequences) / math.log(10) if sequences else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sequences], pa.int64()),
                 pa.array([int(frequent[s].sum()) for s in sequences], pa.int64()),
                 pa.array([logs[s].sum() for s in sequences], pa.float64()), pa.array(likelihood, pa.float64())],
                names=["key", "row", "n_tokens", "n_known", "base", "score"])
    return run


def query(spark, folder: str) -> DataFrame:
    """All documents scored by a model of those whose remainder modulo 5 isn't 1."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 5) == 1
    out = score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
