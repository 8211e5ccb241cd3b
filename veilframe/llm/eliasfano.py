"""Elias-Fano sequences over numpy arrays, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) in a bit vector of 64-bit words; before: set bits before each word."""
    at = np.searchsorted(before, k, "right") - 1
    word, left, pos = words[at].copy(), (k - before[at]).astype(np.int64), np.zeros(len(k), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & U64((1 << step) - 1)).astype(np.int64)
        up = left >= low
        left -= np.where(up, low, 0)
        word = np.where(up, word >> U64(step), word)
        pos += np.where(up, step, 0)
    return at * 64 + pos


class EliasFano:
    """A sorted sequence of whole numbers: low bits packed, high parts in unary; `arrays` are what is stored."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.n, self.width, self.top = (int(x) for x in arrays["head"])
        self.low, self.high = arrays["low"], arrays["high"]
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else np.zeros(1, np.int64)
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values, n = np.asarray(values, np.int64), len(values)
        if n and (values[0] < 0 or (values[1:] < values[:-1]).any()):
            raise ValueError("values must be sorted and not negative")
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * width + 63) // 64 + 1, U64)
        part, bit = (values & ((1 << width) - 1)).astype(U64), np.arange(n) * width
        if width:
            word, shift = bit >> 6, (bit & 63).astype(U64)
            np.bitwise_or.at(low, word, part << shift)
            over = (bit & 63) + width > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        spot = (values >> width) + np.arange(n)
        high = np.zeros((n + (top >> width) + 2 + 63) // 64 + 1, U64)
        np.bitwise_or.at(high, spot >> 6, U64(1) << (spot & 63).astype(U64))
        return cls({"head": np.array([n, width, top], np.int64), "low": low, "high": high})

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(U64)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((first | second) & U64((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        spot = _select(self.high, self.ones, i)
        return ((spot - i) << self.width) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, or -1: the bucket of its high part is found by select, its successor there by halving."""
        x = np.asarray(x, np.int64)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        where = np.nonzero((x >= 0) & (x < self.top))[0]
        h = x[where] >> self.width
        flipped = ~self.high
        lo = np.where(h > 0, _select(flipped, self.zeros, np.maximum(h - 1, 0)) - (h - 1), 0)
        # the zero that ends the bucket, where it stands in the word in which the bucket begins
        spot = lo + h
        rest = flipped[spot >> 6] >> (spot & 63).astype(U64)
        hi = lo + np.bitwise_count((rest & -rest) - U64(1)).astype(np.int64)
        far = np.nonzero(rest == 0)[0]
        hi[far] = _select(flipped, self.zeros, h[far]) - h[far]
        end, want = hi.copy(), x[where] & ((1 << self.width) - 1)
        while len(open_ := np.nonzero(lo < hi)[0]):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        here = np.nonzero(lo < end)[0]
        hit = here[self._low(lo[here]) == want[here]]
        out[where[hit]] = lo[hit]
        return out
