"""Maximal repeats of a set of byte strings: an enhanced suffix array and its common-prefix intervals.

Prefix doubling on 8-byte words ranks all suffixes by their first bytes, which
sorts them into the intervals that share ``least`` bytes, the roots of the
interval tree.  A root all of whose suffixes follow the same byte holds no
maximal repeat and is left out at once.  The other roots are sorted to the end,
and one scan with a stack over their neighbours' common prefixes visits the
tree; an interval whose suffixes follow different bytes cannot be extended to
the left and is a maximal repeat, given with all its occurrences.

A string may stand for several equal ones.  It is then a leaf that occurs more
than once, and a repeat by itself unless a neighbour shares all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Left neighbour of a string's first byte, and of an interval with different left neighbours.
_NONE, _DIVERSE = -1, -2


def _ranks(data: np.ndarray, top: int) -> np.ndarray:
    """Rank of the ``top`` (a power of two, from 8) bytes from every place; places beyond the end count as zero bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + n]
    ranks, deep = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while deep < top:
        later = np.zeros(n, np.int64)
        later[: max(0, n - deep)] = ranks[deep:] + 1
        ranks, deep = np.unique(ranks * (n + 2) + later, return_inverse=True)[1].astype(np.int64), 2 * deep
    return ranks


def maximal_repeats(texts: list[bytes], least: int, counts: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, text numbers, offsets) of every maximal repeat of at least ``least`` (8 or more) bytes within the texts.

    ``counts`` says for how many equal strings each text stands.
    """
    several = {k for k, t in enumerate(texts) if counts and counts[k] > 1 and len(t) >= least}
    for length, numbers, offsets, inner in _shared_repeats(texts, least, several):
        several.difference_update(inner)
        yield length, numbers, offsets
    for k in sorted(several):
        yield len(texts[k]), np.array([k]), np.array([0])


def _shared_repeats(texts: list[bytes], least: int, several: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[int]]]:
    """Maximal repeats with two or more suffixes, and which of ``several`` are wholly shared with another text there."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    firsts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - least + 1))
    if len(own) < 2:
        return
    windows = np.maximum(0, sizes - least + 1)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = firsts[own] + offset
    top = 1 << (least.bit_length() - 1)
    ranks = _ranks(data, top)
    head, tail = ranks[at], ranks[at + least - top]
    order = np.lexsort((at, tail, head))
    at, own, offset, head, tail = at[order], own[order], offset[order], head[order], tail[order]
    same = (head[1:] == head[:-1]) & (tail[1:] == tail[:-1])
    left = np.where(offset > 0, data[at - 1].astype(np.int64), _NONE)
    room = sizes[own] - offset
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    if not len(edges):
        return
    bounds = edges + np.tile([0, 1], len(edges) // 2)  # first of a root, and the place after its last
    smallest = np.minimum.reduceat(np.append(left, 0), bounds)[::2]
    largest = np.maximum.reduceat(np.append(left, 0), bounds)[::2]
    edges = edges.reshape(-1, 2)[(smallest != largest) | (smallest == _NONE)].ravel()
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        run = slice(a, b + 1)
        # suffixes of one run share ``least`` bytes; sort them by all that follows within their own strings
        tails = [data[p : p + r].tobytes() for p, r in zip(at[run].tolist(), room[run].tolist(), strict=True)]
        inner = sorted(range(len(tails)), key=tails.__getitem__)
        places = a + np.array(inner)
        shared = [_common(tails[i], tails[j], least) for i, j in zip(inner, inner[1:], strict=False)]
        for length, lo, hi in _intervals(shared, left[places].tolist()):
            members, starts = own[places[lo : hi + 1]], offset[places[lo : hi + 1]]
            yield length, members, starts, [k for k, o in zip(members.tolist(), starts.tolist(), strict=True) if o == 0 and k in several and sizes[k] == length]


def _common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are."""
    lo, hi = known, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _intervals(shared: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of neighbours' common prefixes whose left bytes differ."""
    stack: list[list[int]] = []  # length, first, and the left byte that all members have, or _DIVERSE
    for i in range(1, len(left) + 1):
        now = shared[i - 1] if i <= len(shared) else -1
        first, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            length, first, inner = stack.pop()
            byte = _joined(inner, byte)
            if byte == _DIVERSE:
                yield length, first, i - 1
        if stack and stack[-1][0] == now:
            stack[-1][2] = _joined(stack[-1][2], byte)
        elif now >= 0:
            stack.append([now, first, byte])


def _joined(x: int, y: int) -> int:
    return x if x == y and x >= 0 else _DIVERSE
