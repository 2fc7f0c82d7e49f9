"""Words of whole Arrow text columns as numpy arrays, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 continuation bytes never
fall in that set, so cutting bytes is the same as cutting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits only: ASCII ones and every byte of a character beyond ASCII.
ALNUM_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Powers of the base and of its inverse, grown on demand.
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _P), ("q", _P_INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the offsets of each (n + 1 of them). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n + 1 of them)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word's bytes (A-Z lower-cased if asked)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, q = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def pieces(column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with about ``max_bytes`` each (a longer text stands alone)."""
    _, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def window_hashes(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` consecutive words of each text, and the index of each text's first
    window. A text with 1 to n-1 words has one window: all its words."""
    counts = np.diff(first)
    wins = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(wins)])
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, np.uint64), out_first
    at = np.arange(total) - np.repeat(out_first[:-1], wins) + np.repeat(first[:-1], wins)
    stop = np.repeat(first[1:], wins)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    h = np.zeros(total, np.uint64)
    for k in range(n):
        use = at + k < stop
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(use, padded[at + k] | np.uint64(1), np.uint64(0))
    return mix(h), out_first
