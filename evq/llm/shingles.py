"""Hashes of word shingles and MinHash values."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import words

SHINGLE, HASHES, ROWS = 5, 128, 4  # ROWS values of 16 bits make a band's key of 64
BANDS = HASHES // ROWS
_REMEMBERED = 1 << 16
_KNOWN: dict[bytes, int] = {}

_rng = np.random.default_rng(20_11)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _learn(w: bytes) -> int:
    if len(_KNOWN) > _REMEMBERED:
        _KNOWN.clear()
    h = _KNOWN[w] = xxhash.xxh3_64_intdigest(w)
    return h


def word_hashes(text: str | None) -> np.ndarray:
    get = _KNOWN.get
    ws = words(text)
    return np.fromiter([get(w) or _learn(w) for w in ws], np.uint64, len(ws))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _P + h[k : len(h) - n + 1 + k]
    return mixed(out)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a text of fewer than n words is one shingle, an empty one none."""
    h = word_hashes(text)
    return np.unique(runs(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits; two sets agree in each with the probability of their Jaccard similarity, and by chance
    with one of 2^-16 more."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 128):  # stays in the cache
        out = np.minimum(out, (shingles[at : at + 128, None] * _A + _B).min(0))
    return (mixed(out) >> np.uint64(48)).astype(np.uint16)


def packed(signature: np.ndarray) -> np.ndarray:
    """A signature as BANDS numbers of 64 bits, each the ROWS values of a band side by side."""
    return signature.view(np.int64)


def unpacked(bands: np.ndarray) -> np.ndarray:
    """Signatures (rows of HASHES values) from their bands one after another."""
    return bands.astype(np.int64).view(np.uint16).reshape(-1, HASHES)
