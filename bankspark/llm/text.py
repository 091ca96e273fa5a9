"""Vectorised text helpers that run inside Arrow tasks.

Texts of an Arrow batch are handled as one flat byte buffer with document offsets, in
pieces of about ``PIECE`` bytes (a longer document is one piece), so the memory of a task
does not follow the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BASE = int(mix(np.array([12345], dtype=np.uint64))[0]) | 5
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
BYTE_VALUE_LOWER = BYTE_VALUE[LOWER]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    size = 1 << max(21, (n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        if size > 1 << 22:
            return tuple(out)
        _powers[size] = tuple(out)
    return _powers[size]


class RollingHash:
    """Hash of every substring of a byte buffer from one running sum."""

    def __init__(self, buf: np.ndarray, lower: bool = False):
        power, self.inverse = _power_tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((BYTE_VALUE_LOWER if lower else BYTE_VALUE)[buf] * power[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of non-separators; runs never cross rows."""
    inside = ~IS_SEP[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        same = inside[1:] & inside[:-1]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(buf))]
        same[cut - 1] = False
        first[1:] &= ~same
        last[:-1] &= ~same
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off[1:], start, "right")


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (A-Z lower-cased) and row of every word."""
    start, end, row = words(buf, off)
    return RollingHash(buf, lower=True).of(start, end), row


#: Multiplier of the j-th word of a shingle.
STEPS = [_U(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(64)]


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles, sorted by (row, hash): rows and hashes.

    A row of fewer than k words, but one at least, has its whole sequence as one shingle.
    """
    h, row = word_hashes(buf, off)
    n = len(h)
    per_row = np.bincount(row, minlength=len(off) - 1)
    total = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        total += h[j: j + len(total)] * STEPS[j]
    whole = row[: len(total)] == row[k - 1:] if len(total) else np.zeros(0, bool)
    hs, rows = mix(total[whole]), row[: len(total)][whole]
    short = np.flatnonzero((per_row > 0) & (per_row < k))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(per_row)])[short]
        value = per_row[short].astype(np.uint64) * _U(0xA0761D6478BD642F)
        for j in range(k - 1):
            has = per_row[short] > j
            value[has] += h[begin[has] + j] * STEPS[j]
        hs, rows = np.concatenate([hs, mix(value)]), np.concatenate([rows, short])
    order = np.lexsort((hs, rows))
    hs, rows = hs[order], rows[order]
    keep = np.ones(len(hs), dtype=bool)
    keep[1:] = (hs[1:] != hs[:-1]) | (rows[1:] != rows[:-1])
    return rows[keep], hs[keep]
