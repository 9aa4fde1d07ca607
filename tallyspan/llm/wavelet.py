"""Wavelet matrix: a sequence of integers as bit planes with rank, select and access.

Each plane holds one bit of every symbol, highest first; a plane's zeros keep their order
in the next plane before its ones. All methods take and give numpy arrays.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words, with the ones before every word."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @classmethod
    def of(cls, bits: np.ndarray) -> BitVector:
        packed = np.packbits(bits, bitorder="little")
        return cls(np.append(packed, np.zeros(8 + -len(packed) % 8, np.uint8)).view(np.uint64), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def select(self, k: np.ndarray, bit: bool = True) -> np.ndarray:
        """Place of the k-th (from 0) one or zero; k must be below their count."""
        ones = self.before if bit else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(ones, k, "right") - 1
        rest = k - ones[word]
        held = self.words[word] if bit else ~self.words[word]
        low = np.zeros(len(word), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            inside = (held >> low.astype(np.uint64)) & ((np.uint64(1) << np.uint64(width)) - np.uint64(1))
            n = np.bitwise_count(inside).astype(np.int64)
            beyond = rest >= n
            rest, low = np.where(beyond, rest - n, rest), np.where(beyond, low + width, low)
        return word * 64 + low


class WaveletMatrix:
    def __init__(self, planes: list[BitVector], n: int):
        self.planes, self.n = planes, n
        self.zeros = [n - int(p.before[-1]) for p in planes]

    @classmethod
    def of(cls, symbols: np.ndarray, width: int) -> WaveletMatrix:
        """width: bits of the largest symbol."""
        planes, now = [], symbols
        for shift in range(width - 1, -1, -1):
            bits = (now >> shift) & 1 != 0
            planes.append(BitVector.of(bits))
            now = np.concatenate([np.compress(~bits, now), np.compress(bits, now)])  # several times as fast as now[bits]
        return cls(planes, len(symbols))

    def all(self, dtype=np.uint32) -> np.ndarray:
        """The whole sequence, from the last plane up: each plane says how its zeros and
        ones were dealt into the next."""
        now = np.zeros(self.n, dtype)
        for shift, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits, above = plane.bits(), np.empty(self.n, dtype)
            above[np.flatnonzero(~bits)] = now[:zeros]
            above[np.flatnonzero(bits)] = now[zeros:] | dtype(1 << shift)
            now = above
        return now

    def access(self, i: np.ndarray) -> np.ndarray:
        return self.access_rank(i)[0]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and how often each occurs before its place."""
        at, start, symbol = i.astype(np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, at_ones, start_ones = plane.get(at), plane.rank(at), plane.rank(start)
            at, start = np.where(bit, zeros + at_ones, at - at_ones), np.where(bit, zeros + start_ones, start - start_ones)
            symbol = symbol << 1 | bit
        return symbol, at - start

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i."""
        at, start = i.astype(np.int64), np.zeros(len(i), np.int64)
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = symbol >> (len(self.planes) - 1 - level) & 1 != 0
            at_ones, start_ones = plane.rank(at), plane.rank(start)
            at, start = np.where(bit, zeros + at_ones, at - at_ones), np.where(bit, zeros + start_ones, start - start_ones)
        return at - start

    def count(self, symbol: int) -> int:
        return int(self.rank(np.array([symbol]), np.array([self.n]))[0])

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) occurrences of a symbol."""
        width, start, path = len(self.planes), np.zeros(1, np.int64), []
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = bool(symbol >> (width - 1 - level) & 1)
            start = zeros + plane.rank(start) if bit else start - plane.rank(start)
            path.append((plane, zeros, bit))
        at = start + k
        for plane, zeros, bit in reversed(path):
            at = plane.select(at - zeros if bit else at, bit)
        return at

    def occurrences(self, symbol: int) -> np.ndarray:
        return self.select(symbol, np.arange(self.count(symbol)))
