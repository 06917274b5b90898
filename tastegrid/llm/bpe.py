"""Byte-level BPE encoding and decoding with a public tokenizer file.

Texts are split into pieces by the tokenizer's pattern; the pieces of a slice of texts that are new to the task are encoded
together. Their symbols stand in one linked list; an index maps every pair that has a rank to all its positions. Active ranks
are applied in ascending order: each application merges all positions of its pair at once and files the pairs it creates
under their own ranks. A merge only ever creates pairs of higher rank, so one ascending pass is exact.

Defined cases: a null text is empty and has no tokens; special tokens' strings inside a text are their special ids; repeated
rows are encoded each; very long pieces take time in proportion to their length and depth of merges; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tastegrid.llm.common import column
from tastegrid.llm.sketch import slices

# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Model:
    """Vocabulary, merges by rank, and special tokens of one tokenizer file."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = (self.left << 32) | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


def _first_of_runs(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """From left to right, the positions that don't overlap the one taken before: for pairs of one symbol with itself."""
    taken, blocked = [], -1
    for p, n in zip(at.tolist(), after.tolist()):
        if p != blocked:
            taken.append(p)
            blocked = n
    return np.array(taken, np.int64)


def encode_pieces(pieces: list[bytes], model: Model) -> list[bytes]:
    """Token ids (little-endian, 32 bits) of pieces, none of them empty, by the pair occurrence index."""
    if not pieces:
        return []
    lengths = np.array([len(p) for p in pieces])
    symbols = model.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbols)
    ends = np.cumsum(lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[ends - lengths] = -1

    index: dict[int, list[int]] = {}
    starts = np.flatnonzero(after >= 0)
    ranks = model.ranks(symbols[starts], symbols[starts + 1])
    starts, ranks = starts[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    starts, ranks = starts[order], ranks[order]
    if len(ranks):
        heads = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ranks)]):
            index[int(ranks[a])] = starts[a:b].tolist()
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        at = np.unique(np.array(index.pop(rank), np.int64))
        left, right = model.left[rank], model.right[rank]
        at = at[(symbols[at] == left) & (after[at] >= 0)]
        at = at[symbols[after[at]] == right]
        if left == right and len(at) > 1:
            at = _first_of_runs(at, after[at])
        if not len(at):
            continue
        gone = after[at]
        rest = after[gone]
        symbols[at], symbols[gone] = model.made[rank], -1
        after[at] = rest
        held = rest >= 0
        before[rest[held]] = at[held]
        first = np.concatenate([before[at], at[held]])
        first = first[first >= 0]
        new = model.ranks(symbols[first], symbols[after[first]])
        found = new >= 0
        for r, p in zip(new[found].tolist(), first[found].tolist()):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(active, r)
    alive = symbols >= 0
    counts = np.add.reduceat(alive, ends - lengths)
    data = symbols[alive].astype("<u4").tobytes()
    stops = (np.cumsum(counts) * 4).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops)]


class Encoder:
    """Encodes texts; pieces seen before are remembered, up to a bound."""

    BOUND = 300_000

    def __init__(self, model: Model):
        self.model = model
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {s: i.to_bytes(4, "little") for s, i in model.special.items()}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(model.special, key=len, reverse=True))) + ")") \
            if model.special else None

    def pieces(self, text: str) -> list[str]:
        if self.cuts is None or not self.cuts.search(text):
            return self.split(text)
        out = []
        for i, part in enumerate(self.cuts.split(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        known = self.known
        new = list({p for pieces in split for p in pieces if p not in known})
        known.update(zip(new, encode_pieces([p.encode("utf-8", "surrogatepass") for p in new], self.model)))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        if len(known) > self.BOUND:
            self.known = {s: known[s] for s in self.model.special}
        return out


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, ids) per row; ``ids`` holds the token ids as little-endian unsigned 32-bit integers."""
    file = df.sparkSession.sparkContext.broadcast(open(path or default_path(), "rb").read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Model(file.value))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 1 << 21):
                ids = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary())], names=["key", "n_tokens", "ids"])

    rows = df.select(column(key).alias("key"), column(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary").withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the text of its token ids (special tokens included) as one more column."""
    file = df.sparkSession.sparkContext.broadcast(open(path or default_path(), "rb").read())
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or Model(file.value).token_bytes
            texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
                     for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, into])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(into, StringType())]))


def query(spark, folder: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    done = decode(encode(spark.read.parquet(f"{folder}/documents.parquet")))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
