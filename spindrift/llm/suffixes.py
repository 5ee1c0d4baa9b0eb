"""Suffix order of integer sequences to a given depth, by prefix doubling in numpy."""

from __future__ import annotations

import numpy as np


def depth_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """rank[i] of the suffix at i by its first ``depth`` symbols; equal ranks: equal prefixes.

    ``symbols`` are non-negative integers.  Suffixes shorter than ``depth`` get ranks of their own.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if depth >= 4 and n >= 4 and symbols.max() < 1 << 15:
        # Four symbols at once to begin with.
        packed = np.zeros(n, dtype=np.int64)
        for i in range(4):
            packed[: n - i] |= (symbols[i:] + 1) << np.int64(16 * (3 - i))
        rank, have = np.unique(packed, return_inverse=True)[1].astype(np.int64), 4
    else:
        rank, have = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        later = np.full(n, -1, dtype=np.int64)
        later[: max(0, n - step)] = rank[step:] if step < n else later[:0]
        key = (rank + 1) * np.int64(n + 1) + (later + 1)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        have += step
    short = np.arange(max(0, n - depth + 1), n)
    rank[short] = rank.max(initial=0) + 1 + np.arange(len(short))
    return rank


def factor_matches(symbols: np.ndarray, depth: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later) for each of ``starts``: has the suffix there a match of ``depth`` symbols before or after it?

    In suffix order, with equal prefixes by position, the previous smaller position of a suffix
    is the entry before it and the next one after it lies behind; the longest previous (next)
    factor reaches ``depth`` exactly if that neighbour has an equal prefix.
    """
    rank = depth_ranks(symbols, depth)[starts]
    order = np.lexsort((starts, rank))
    same = np.zeros(len(starts) + 1, dtype=bool)
    same[1:-1] = rank[order][1:] == rank[order][:-1]
    earlier = np.zeros(len(starts), dtype=bool)
    later = np.zeros(len(starts), dtype=bool)
    earlier[order], later[order] = same[:-1], same[1:]
    return earlier, later
