"""Flat views of a batch of texts: one byte array with row offsets, and vectorised words and hashes.

Operators of this folder work on whole Arrow batches: the UTF-8 bytes of all texts lie in one numpy
array, and words, shingles or windows are spans into it. Work arrays are several times as large as
the bytes, so batches are cut into blocks of rows of about ``BLOCK_BYTES``; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and row offsets into them. A null text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def flat_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each block of a column of texts."""
    data, offsets = flat(column)
    for i, j in blocks(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, set outside the given inclusive ranges."""
    good = np.ones(256, bool)
    for low, high in ranges:
        good[low : high + 1] = False
    return good


#: Words are what stands between blanks and control white space.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))


def words(data: np.ndarray, offsets: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the longest runs of good bytes; a run ends with its row."""
    n = len(data)
    inside = good[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= edge[1:n] | ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= edge[1:n] | ~inside[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, rows_of(offsets, starts)


def rows_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 1 << 23:
            _powers[base] = known
    return known[:n]


def running_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial sum of the bytes before each position: what ``hash_spans`` takes differences of."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_R, len(data)), out=sums[1:])
    return sums


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span of bytes, from differences of one running polynomial sum."""
    sums = running_sums(data) if sums is None else sums
    inverse = _power(_R_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hash_grams(sums: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the string of ``length`` bytes at each position where one fits."""
    n = max(len(sums) - length, 0)
    return mix((sums[length:] - sums[:n]) * _power(_R_INVERSE, n))


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One ordered 64-bit hash of several columns of hashes."""
    h = np.full(len(columns[0]), 0x51ED270B7F4A7C15, np.uint64)
    for c in columns:
        h = mix(h * np.uint64(_R) + c)
    return h


def counts_of(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)[:n].astype(np.int64)


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values in each row; empty rows give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of spans, span after span."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def uniques(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different spans as bytes, and for each span the number of its equal among them."""
    _, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], inverse
