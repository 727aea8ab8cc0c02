"""A full-text index of word codes in small space: the Burrows-Wheeler transform in a wavelet tree.

Backward search narrows the interval of suffixes that begin with a pattern, from the pattern's last word to its first,
with two rank queries a word. All searches run side by side in array code.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    """Bits with rank: 64 to a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((_ONE << bit) - _ONE))


class WaveletTree:
    """Rank of any symbol, level by level from the highest bit; the nodes of a level lie side by side in one row of bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(size - 1).bit_length())
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = (now >> level & 1).astype(bool)
            self.levels.append(_Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[~bits], now[bits]])
        self.first = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of each position."""
        return self._down(symbol, at) - self.first[symbol]


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` codes or more, by doubling; beyond, in order of position."""
    rank, known = codes.astype(np.int64), 1
    while True:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-known] = rank[known:] + 1 if known < len(rank) else 0
        order = np.argsort(rank * (int(ahead.max()) + 1) + ahead, kind="stable")
        known *= 2
        if known >= depth:
            return order
        new = np.ones(len(rank), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (rank[a] != rank[b]) | (ahead[a] != ahead[b])
        if new.all():
            return order
        again = np.empty(len(rank), np.int64)
        again[order] = np.cumsum(new) - 1
        rank = again


class FMIndex:
    """``codes`` from 0 to ``size`` - 1; patterns of up to ``depth`` codes can be searched."""

    def __init__(self, codes: np.ndarray, size: int, depth: int):
        order = suffix_order(codes, depth)
        self.depth = depth
        self.tree = WaveletTree(codes[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=size))])

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, limit: int, least: int = 2):
        """For each end in ``text``: the longest run of up to ``limit`` codes before it that occurs ``least`` times or
        more in the index, and its interval of suffixes (lowest, behind the highest)."""
        if limit > self.depth:
            raise ValueError("the index is not ordered that deep")
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.smaller[-1])
        going = np.arange(len(ends))
        for step in range(1, limit + 1):
            going = going[ends[going] >= step]
            if not len(going):
                break
            code = text[ends[going] - step]
            edge = self.tree.rank(np.concatenate([code, code]), np.concatenate([low[going], high[going]]))
            lo, hi = self.smaller[code] + edge[: len(going)], self.smaller[code] + edge[len(going) :]
            wide = hi - lo >= least
            going, lo, hi = going[wide], lo[wide], hi[wide]
            length[going], low[going], high[going] = step, lo, hi
        return length, low, high
