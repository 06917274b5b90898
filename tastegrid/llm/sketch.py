"""Shingle sets of texts and their fast similarity sketches, on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    each = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, _U)
    for i in range(width):
        out = mix((out * _U(0x9E3779B97F4A7C15)) ^ each[i:i + n])
    return np.unique(out)


def fast_sketches(elements: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """One sketch of ``coordinates`` values per set; ``elements`` holds the sets one after another.

    Round i < t hashes every element to one bin with the value (i, hash); round t + k puts every element into bin k. A bin
    keeps its least value. A set is done after the first round that leaves none of its bins empty, which after all 2t
    rounds holds for every set that isn't empty; rounds needed are few for large sets, so the work is near linear.
    """
    t, n = coordinates, len(sizes)
    sketch = np.full((n, t), _TOP, _U)
    owner = np.repeat(np.arange(n), sizes)
    flat = sketch.reshape(-1)
    left = np.flatnonzero(sizes > 0)
    for i in range(2 * t):
        if not len(left):
            break
        h = mix(elements + _U((i * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        low = h & _U(0xFFFFFFFF)
        bins = (low * _U(t)) >> _U(32) if i < t else np.full(len(h), i - t, _U)
        np.minimum.at(flat, owner * t + bins.astype(np.int64), (_U(i) << _U(48)) | (h >> _U(16)))
        full = (sketch[left] != _TOP).all(axis=1)
        if full.any():
            left = left[~full]
            open_ = np.zeros(n, bool)
            open_[left] = True
            keep = open_[owner]
            elements, owner = elements[keep], owner[keep]
    return sketch


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band's number is part of the key."""
    n, t = sketch.shape
    blocks = sketch.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(t // rows, dtype=_U), blocks.shape[:2]).copy()
    for i in range(rows):
        key = mix((key * _U(0x9E3779B97F4A7C15)) ^ blocks[:, :, i])
    return key.view(np.int64)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if not len(a) or not len(b):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def slices(texts: list, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts hold about ``limit`` characters, one text at least."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
