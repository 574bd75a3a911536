"""Hashed word shingles of whole texts, for the operators that compare them."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import ascii_lower_words

#: Words in a shingle.
WORDS = 5
#: Distinct words a worker remembers the hashes of, within a task.
KEPT = 150_000
ODD = (np.random.default_rng(5).integers(0, 1 << 63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)
_hashes: dict[bytes, int] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit integers without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    if len(_hashes) > KEPT:
        _hashes.clear()
    for w in {w for w in words if w not in _hashes}:
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def forget() -> None:
    """Drop the words' hashes: at a task's end, as the worker may serve other operators next."""
    _hashes.clear()


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer than ``n`` words one of the whole sequence, without words none."""
    words = ascii_lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    m = min(n, len(h))
    k = len(h) - m + 1
    s = np.full(k, np.uint64(m))
    for j in range(m):
        s += h[j : j + k] * ODD[j]
    return np.unique(mix64(s))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())
