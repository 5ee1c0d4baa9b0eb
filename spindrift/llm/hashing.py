"""Vectorised hashing of words and byte windows: numpy over the buffers of Arrow batches.

A prefix sum of byte * BASE^i (mod 2^64) gives the hash of any byte range in O(1), so the words,
n-grams and windows of many texts are hashed without a Python step for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), kept for the next call."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of (byte + 1) * BASE^i over [s, e)."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def range_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[s:e] for each pair; equal bytes give equal hashes, wherever they are."""
    raw = (pre[ends] - pre[starts]) * powers(INVERSE, len(pre))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - (offsets[0] if len(column) else 0)


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts with at most ``most`` bytes together (or one longer text)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): runs of non-white bytes of each text.

    ``first[i]:first[i+1]`` are the words of text i.  A-Z are lower-cased if ``lower``.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    ink = np.zeros(n + 2, dtype=bool)
    ink[1:-1] = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    # A word starts at ink after a space or at a text's start, and ends likewise.
    here, before = ink[1:], ink[:-1]
    starts = np.flatnonzero(here[:n] & (~before[:n] | cut[:n]))
    ends = np.flatnonzero(before & (~here | cut))
    pre = prefix(LOWER[data] if lower else data)
    return range_hash(pre, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def word_shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its set of ``width``-word shingles as sorted distinct hashes.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    n = len(hashes)
    grams = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    factor = powers(np.uint64(0xA0761D6478BD642F | 1), width + 1)
    for i in range(width):
        grams += hashes[i : n - width + 1 + i] * factor[i + 1] if len(grams) else grams
    grams = mix(grams + np.uint64(width))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            whole = (hashes[a:b] * factor[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
