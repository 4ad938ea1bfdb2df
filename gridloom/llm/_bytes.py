"""Vectorised text scanning on UTF-8 bytes.

All separators are ASCII, so words and lines found on bytes are those that a
scan of the characters would find. A batch of texts is one byte array in which
every text is followed by one line feed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text goes alone.
CHUNK = 1 << 19

SEP = np.zeros(256, bool)
SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE_LOW = _VALUE[LOWER]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + (CHUNK >> 2))
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    if n > 8 * CHUNK:  # an outsize text doesn't keep its tables
        out = _powers[0], _powers[1]
        _powers[0] = _powers[1] = np.ones(1, np.uint64)
        return out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


class Texts:
    """Some texts in one byte array; ``start`` and ``end`` bound each, without its line feed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        size = offsets[1:] - offsets[:-1]
        self.n = n
        self.start = offsets[:-1] - offsets[0] + np.arange(n)
        self.end = self.start + size
        total = int(offsets[-1] - offsets[0])
        self.raw = np.full(total + n, 10, np.uint8)
        keep = np.ones(total + n, bool)
        keep[self.end] = False
        self.raw[keep] = data[offsets[0] : offsets[-1]]
        self._sums: dict[bool, np.ndarray] = {}

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word."""
        w = np.empty(len(self.raw) + 1, bool)
        w[0] = False
        np.logical_not(SEP[self.raw], out=w[1:])
        edge = np.flatnonzero(w[1:] != w[:-1])
        return edge[::2], edge[1::2]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every line, split at line feeds alone."""
        end = np.flatnonzero(self.raw == 10)
        start = np.empty_like(end)
        if len(end):
            start[0] = 0
            start[1:] = end[:-1] + 1
        return start, end

    def owner(self, start: np.ndarray) -> np.ndarray:
        """The text in which each position lies."""
        return np.searchsorted(self.start, start, "right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
        """64-bit hash of each span, with A-Z lower-cased if ``fold``."""
        power, inverse = _power(len(self.raw))
        sums = self._sums.get(fold)
        if sums is None:
            sums = self._sums[fold] = np.empty(len(self.raw) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((_VALUE_LOW if fold else _VALUE)[self.raw] * power[: len(self.raw)], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def count(self, marks: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many marked bytes each span holds."""
        c = np.empty(len(marks) + 1, np.int64)
        c[0] = 0
        np.cumsum(marks, out=c[1:])
        return c[end] - c[start]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts) of runs of rows of about ``limit`` bytes."""
    data, offsets = column(col)
    i, n = 0, len(col)
    give_back()
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, Texts(data, offsets[i : j + 1])
        i = j
    give_back()


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0xFF51AFD7ED558CCD))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
