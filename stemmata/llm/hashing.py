"""Vectorised hashing of words, shingles and byte grams with numpy.

A prefix sum of table entries times powers of an odd base gives the 64-bit
polynomial hash of any slice by one subtraction and one multiplication with the
base's inverse power; results are mixed before use.
"""

from __future__ import annotations

import numpy as np

#: Seed of the byte table and multipliers; they only need to be the same on every executor.
_random = np.random.default_rng(20240917)
BYTE_TABLE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_random.integers(1, 1 << 62)) * 4 + 3
INVERSE = pow(BASE, -1, 1 << 64)
WORD_FACTORS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), wrapped; the longest so far is kept up to 2 M entries."""
    held = _powers[base]
    if len(held) < n:
        held = np.full(n, base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if n <= 1 << 21:
            _powers[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums over data[:i] for i = 0 .. len(data); the base of :func:`slices`."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_TABLE[data] * _power(BASE, len(data)), out=out[1:])
    return out


def slices(sums: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Mixed hashes of data[first:after]; equal slices have equal hashes wherever they stand."""
    inverse = _power(INVERSE, len(sums))
    return mix((sums[after] - sums[first]) * inverse[first] + (after - first).astype(np.uint64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every run of bytes that are not spaces."""
    gap = np.empty(len(data) + 2, bool)
    gap[0] = gap[-1] = True
    np.equal(data, 32, out=gap[1:-1])
    first = np.flatnonzero(gap[:-2] & ~gap[1:-1])
    after = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    return (slices(prefix_sums(data), first, after), first) if len(first) else (np.empty(0, np.uint64), first)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text of space-separated words its sorted distinct hashes of ``n`` consecutive words; fewer words are one shingle."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    words, at = word_hashes(np.frombuffer(b" ".join(texts), np.uint8)) if texts else (np.empty(0, np.uint64), np.empty(0, np.int64))
    bounds = np.searchsorted(at, starts)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n if len(rolled) else 0):
        rolled += words[j : j + len(rolled)] * WORD_FACTORS[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(rolled[a : b - n + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            out.append(mix((words[a:b] * WORD_FACTORS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def batches_of(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Cut a list of sizes into consecutive ranges of at most ``most`` each, or of one larger element."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            out.append((first, i))
            first, held = i, 0
        held += size
    if first < len(sizes):
        out.append((first, len(sizes)))
    return out
