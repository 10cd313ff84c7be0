"""Elias-Fano sequences in memory-mapped files."""

from __future__ import annotations

import tempfile

import numpy as np

_ONE = np.uint64(1)


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in an unnamed file, mapped for reading; the file goes with the mapping."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as f:
        array.tofile(f)
        f.flush()
        return np.memmap(f, array.dtype, "r", shape=array.shape)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with rank counts.

    All methods take arrays of queries.
    """

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n = n
        self.low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        width = np.uint64(self.low_bits)
        high = (values >> width).astype(np.int64)
        self.buckets = int(universe >> self.low_bits) + 1
        marks = np.zeros(-(-(n + self.buckets + 1) // 64) * 64, np.uint8)
        marks[high + np.arange(n)] = 1
        words = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self._high, self._ones = mapped(words), mapped(ones)
        self._zeros = mapped(np.arange(len(ones)) * 64 - ones)
        low = np.zeros(n * self.low_bits // 64 + 2, np.uint64)
        packed = low.view(np.uint8)
        for lo in range(0, n if self.low_bits else 0, 1 << 16):
            bits = (values[lo : lo + (1 << 16), None] >> np.arange(self.low_bits, dtype=np.uint64)) & _ONE
            part = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
            packed[lo * self.low_bits // 8 : lo * self.low_bits // 8 + len(part)] = part
        self._low = mapped(low)

    def _select(self, counts: np.ndarray, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit, from 0, of words whose running counts are given."""
        word = np.searchsorted(counts, k, "right") - 1
        bits, left = words(word), (k - counts[word]).astype(np.int64)
        at = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count((bits >> at.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
            go = left >= below
            left -= np.where(go, below, 0)
            at += np.where(go, step, 0)
        return word * 64 + at

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """Values before bucket h."""
        zero = self._select(self._zeros, lambda w: ~self._high[w], np.maximum(h - 1, 0))
        return np.where(h > 0, zero + 1 - h, 0)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = self._low[word] >> shift
        value |= np.where(shift > 0, self._low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return value & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        one = self._select(self._ones, lambda w: self._high[w], i)
        return ((one - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of the first value >= x, searched within x's bucket and [begin, end); ``end`` if all are less."""
        x = x.astype(np.uint64)
        h = np.minimum((x >> np.uint64(self.low_bits)).astype(np.int64), self.buckets - 1)
        low = x & np.uint64((1 << self.low_bits) - 1)
        lo, hi = self._bucket(h), np.minimum(self._bucket(h + 1), self.n)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
            hi = np.maximum(hi, lo)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of a value equal to x, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        at = self.successor(x, begin, end)
        inside = np.minimum(at, self.n - 1)
        same = (at < self.n) & (self.get(inside) == x.astype(np.uint64))
        if begin is not None:
            same &= (at >= begin) & (at < end)
        return np.where(same, at, -1)
