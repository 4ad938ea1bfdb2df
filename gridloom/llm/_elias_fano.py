"""Elias-Fano monotone sequences in flat byte buffers that can be memory-mapped.

A value is cut into its low ``l`` bits, packed one after another, and its high
part, kept in unary: one bit per element at (high part + index). Directories
count ones and zeros before each 256 bits, so that the k-th one or zero is found
by a search of the directory and a scan of four words. All queries take arrays.
"""

from __future__ import annotations

import numpy as np

_HEAD = 8  # numbers in the header
_WORDS = 4  # of 64 bits, in a block
_MOST_LOW = 62


def _pad(x: bytes) -> bytes:
    return x + bytes(-len(x) % 8)


def encode(values: np.ndarray) -> bytes:
    """Buffer of an ascending sequence of fewer than 2**30 numbers below 2**64."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    l = max(0, min(_MOST_LOW, (max(top, 1) // max(n, 1)).bit_length() - 1))  # noqa: E741
    low = bytearray()
    if l:
        step = 1 << 16  # a multiple of 8, so that each run ends at a byte
        for i in range(0, n, step):
            part = v[i : i + step] & np.uint64((1 << l) - 1)
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :l]
            low += np.packbits(bits.ravel(), bitorder="little").tobytes()
    bits = np.zeros(n + (top >> l) + 1, np.uint8)
    bits[(v >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
    words = np.frombuffer(_pad(np.packbits(bits, bitorder="little").tobytes()), np.uint64)
    words = np.append(words, np.zeros(-len(words) % _WORDS + _WORDS, np.uint64))  # whole blocks, the last all zeros
    ones = np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1, dtype=np.int64)
    ones = np.append(np.cumsum(ones) - ones, [n] if len(ones) % 2 else [])  # an even number
    head = np.array([n, l, top, len(words), len(low), 0, 0, 0], np.uint64)
    return head.tobytes() + words.tobytes() + ones.astype(np.uint32).tobytes() + _pad(bytes(low)) + bytes(16)


_ONE, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_PAIRS, _FOURS, _BYTES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
_U = np.uint64
#: Place of the k-th one of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.uint64)


def _select_in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one of each word; all numbers are 64-bit without sign."""
    x = w - ((w >> _U(1)) & _PAIRS)
    x = (x & _FOURS) + ((x >> _U(2)) & _FOURS)
    upto = ((x + (x >> _U(4))) & _BYTES) * _ONE  # each byte: ones in it and in those below
    shift = np.bitwise_count(((k * _ONE | _HIGH) - upto) & _HIGH).astype(np.uint64) << _U(3)
    k = k - (((upto << _U(8)) >> shift) & _U(255))
    return _IN_BYTE[((w >> shift) & _U(255)) << _U(3) | k] + shift


class Sequence:
    """An encoded sequence; ``buffer`` may be a memory map."""

    def __init__(self, buffer: np.ndarray, offset: int = 0):
        raw = buffer[offset:]
        head = raw[: 8 * _HEAD].view(np.uint64)
        self.n, self.l, self.top, n_words, n_low = (int(x) for x in head[:5])
        at = 8 * _HEAD
        self.words = raw[at : at + 8 * n_words].view(np.uint64)
        at += 8 * n_words
        blocks = n_words // _WORDS
        self.ones = raw[at : at + 4 * blocks].view(np.uint32)
        self.zeros = (np.arange(blocks) * (64 * _WORDS) - self.ones).astype(np.uint32)
        at += 4 * (blocks + blocks % 2)
        self.size = at + n_low + 16 + (-n_low % 8)
        self.low = raw[at : self.size].view(np.uint64)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit place of the k-th one or zero."""
        before = self.ones if one else self.zeros
        block = np.searchsorted(before, k.astype(np.uint32), "right") - 1
        rest = (k - before[block]).astype(np.uint64)
        at = _WORDS * block
        word = self.words[at] if one else ~self.words[at]
        for _ in range(_WORDS - 1):
            n = np.bitwise_count(word)
            on = np.flatnonzero(rest >= n)
            if not len(on):
                break
            rest[on] -= n[on]
            at[on] += 1
            word[on] = self.words[at[on]] if one else ~self.words[at[on]]
        return 64 * at + _select_in_word(word, rest).astype(np.int64)

    def _run(self, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Number of ones from each bit place p, which comes after the k - 1 first zeros, to the next zero."""
        w = self.words[p >> 6] >> (p & 63).astype(np.uint64)
        n = np.bitwise_count((~w & (w + _U(1))) - _U(1)).astype(np.int64)  # ones below the first zero
        over = np.flatnonzero(n + (p & 63) >= 64)
        if len(over):
            n[over] = self._select(k[over], False) - p[over]
        return n

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i * self.l
        word, shift = bit >> 6, (bit & 63).view(np.uint64)
        x = self.low.take(word) >> shift | self.low.take(word + 1) << _U(1) << (_U(63) - shift)
        return x & _U((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        return self.place(np.asarray(i, np.int64))[1]

    def place(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bit place and value of the elements at the places i."""
        at = self._select(i, True)
        return at, ((at - i).astype(np.uint64) << _U(self.l)) | self._low(i)

    def after(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Values at the places i, each after the element whose bit place is ``at``."""
        p = at + 1
        w = self.words[p >> 6] >> (p & 63).astype(np.uint64)
        p += np.bitwise_count((w & (~w + _U(1))) - _U(1)).astype(np.int64)
        far = np.flatnonzero(w == 0)
        if len(far):
            p[far] = self._select(i[far], True)
        return ((p - i).astype(np.uint64) << _U(self.l)) | self._low(i)

    def _begin(self, high: np.ndarray, near: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Bit place after the first ``high`` zeros; ``near``: a bit place before it, and the zeros before that."""
        if near is None:
            return np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        p, skip = near[0].copy(), high - near[1]
        w = ~self.words[p >> 6] >> (p & 63).astype(np.uint64)
        here = np.flatnonzero((skip > 0) & (skip <= np.bitwise_count(w)))
        far = np.flatnonzero(skip > np.bitwise_count(w))
        p[here] += _select_in_word(w[here], (skip[here] - 1).astype(np.uint64)).astype(np.int64) + 1
        if len(far):
            p[far] = self._select(high[far] - 1, False) + 1
        return p

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Place of the first element that equals each number among the places first..last - 1, or -1.

        ``near``: for each number a bit place before those of the elements that equal it, and the zeros before that.
        """
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        live = np.flatnonzero(x <= np.uint64(self.top)) if self.n else np.zeros(0, np.int64)
        if not len(live):
            return out
        y = x[live]
        high = (y >> np.uint64(self.l)).astype(np.int64)
        # places of the elements with this high part
        p = self._begin(high, near and (near[0][live], near[1][live]))
        lo = p - high
        hi = lo + self._run(p, high)
        lo = np.maximum(lo, first[live] if isinstance(first, np.ndarray) else first)
        if last is not None:
            hi = np.minimum(hi, last[live])
        low = y & np.uint64((1 << self.l) - 1)
        # halved until one place is left, which alone is compared
        open_ = np.flatnonzero(hi - lo > 1)
        while len(open_):
            mid = (lo[open_] + hi[open_] - 1) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less] + 1
            open_ = open_[hi[open_] - lo[open_] > 1]
        inside = np.flatnonzero(lo < hi)
        hit = inside[self._low(lo[inside]) == low[inside]]
        out[live[hit]] = lo[hit]
        return out
