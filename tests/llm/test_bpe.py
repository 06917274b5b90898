"""BPE against the public library, and the round trip."""

import random

import numpy as np
import pytest

from tastegrid.llm import bpe
from tests.llm.cases import documents, empty, rows


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())


def test_random_texts(library):
    encoder = bpe.Encoder(bpe.Model(open(bpe.default_path(), "rb").read()))
    rng = random.Random(5)
    letters = [*"abeé 's't\n\t\x1c\x85\xa0᠎​  　²½Ⅷ中文😀ß'llaaa0019", "<|endoftext|>", "<|endof", "  ", "aaaa", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4_000)]
    texts += ["a" * 50_000 + "b" * 999 + "xyz" * 9_000, "é" * 5_000]
    for ours, theirs in zip(encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ours, "<u4").tolist() == theirs.ids


def test_slices_without_new_pieces():
    encoder = bpe.Encoder(bpe.Model(open(bpe.default_path(), "rb").read()))
    assert encoder.encode([]) == [] and encoder.encode(["", ""]) == [b"", b""]
    assert encoder.encode(["a b"]) == encoder.encode(["a b"])


def test_odd_cases_and_round_trip(spark, library):
    texts = [r[1] or "" for r in rows()]
    out = bpe.decode(bpe.encode(documents(spark))).collect()
    assert sorted(r.text for r in out) == sorted(texts)
    assert sorted(r.n_tokens for r in out) == sorted(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert bpe.encode(empty(spark)).count() == 0
