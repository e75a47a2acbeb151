"""Hashed word shingles of whole texts, computed on byte buffers."""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_RING = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
_TABLE = np.random.RandomState(20240607).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def ring(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the ring element and of its inverse, up to n - 1."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for r in (_RING, pow(_RING, -1, 1 << 64)):
                steps = np.full(size, r, np.uint64)
                steps[0] = 1
                _powers.append(np.multiply.accumulate(steps))
        del _powers[:-2]
    return _powers[0], _powers[1]


def word_hashes(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of bytes other than ASCII blanks, A-Z lowered), and words per document."""
    n = len(flat)
    docs = len(offs) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    word = ~_BLANK[flat]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offs[1:-1]
    inner = inner[inner < n]
    begins[inner] = word[inner]  # a word ends with its document
    start = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    stops[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
    stop = np.flatnonzero(stops) + 1
    power, inverse = ring(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[flat] * power[:n], out=sums[1:])
        h = mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * _M3)
    return h, np.diff(np.searchsorted(start, offs))


def shingle_sets(flat: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles.

    A document of fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    h, per = word_hashes(flat, offs)
    out, at = [], 0
    salts = [mix(np.array([i + 1], np.uint64) * _M3)[0] | np.uint64(1) for i in range(k)]
    with np.errstate(over="ignore"):
        n = max(0, len(h) - k + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(k):
            rolled += h[i : i + n] * salts[i]
        rolled = mix(rolled + np.uint64(k) * _M3)
        for words in per.tolist():
            if words >= k:
                s = np.sort(rolled[at : at + words - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif words:
                whole = sum((h[at + i] * salts[i] for i in range(words)), np.uint64(0)) + np.uint64(words) * _M3
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += words
    return out
