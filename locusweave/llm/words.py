"""Vectorised word hashes over UTF-8 bytes.

A word is a maximal run of bytes other than \\x20 and \\x09-\\x0D; A-Z are
lower-cased. Hashes are 64 bits wide and need no Python object per word.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240607)
#: One random 64-bit value a byte; upper case shares that of lower case.
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = BYTE_VALUES.copy()
FOLDED[ord("A") : ord("Z") + 1] = FOLDED[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of words up to each row's start (one entry more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles and where each row's begin.

    rows: word offsets of the rows. A row of fewer than k words has one shingle,
    the whole sequence; a row without words has none.
    """
    counts = np.diff(rows)
    each = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(each)])
    first = np.repeat(rows[:-1] - at[:-1], each) + np.arange(at[-1])
    used = np.repeat(np.minimum(counts, k), each)
    total = np.zeros(at[-1], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            more = used > i
            total = np.where(more, total * np.uint64(0xC2B2AE3D27D4EB4F) + words[np.minimum(first + i, max(len(words) - 1, 0))] if len(words) else total, total)
        return mix(total + used.astype(np.uint64) * np.uint64(0x165667B19E3779F9)), at
