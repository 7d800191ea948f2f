"""Vectorised work on whole UTF-8 texts: words, their hashes and spans, over Arrow buffers.

Texts are handled in blocks of whole rows of at most ``BLOCK`` bytes (one longer text is a
block of its own), so memory is bounded by the block or the longest text, never by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)

#: ASCII whitespace: space and \t \n \v \f \r
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: digits, letters and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: lower-cases A-Z and nothing else
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row offsets in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of consecutive whole rows of at most ``limit`` bytes."""
    data, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, BLOCK + 1)
        steps = np.full(size, _ODD)
        steps[0] = 1
        powers = np.cumprod(steps, dtype=np.uint64)
        if size > 4 * BLOCK:  # of one very long text: not kept
            return powers
        _POWERS = powers
    return _POWERS


@dataclass
class Words:
    """Words of a block: byte spans, and the first word of each row (and the total last)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal words have equal hashes in any text."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        powers = _powers(len(self.data) + 1)
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers[n - self.start] * np.uint64(pow(int(_ODD), -n, 1 << 64)))

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of the bytes in ``member`` within each row."""
    if lower:
        data = LOWER[data]
    inside = member[data]
    n = len(data)
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = offsets[:-1][np.diff(offsets) > 0]
        begins[full] = inside[full]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
