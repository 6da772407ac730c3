"""A compressed FM-index over integer sequences: Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class PackedBits:
    """A bit vector with constant-time rank: 64-bit words and one running count for each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, upto: np.ndarray) -> np.ndarray:
        """Number of set bits before each position."""
        word = upto >> 6
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int32)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        self.depth = max(1, int(sigma - 1).bit_length())
        at = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = (at >> level) & 1
            self.levels.append(PackedBits(bits))
            at = np.concatenate([at[bits == 0], at[bits == 1]])

    def positions(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Where the occurrences of each symbol before a position end, in the order of the last level."""
        at = upto
        for level, bits in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where((symbols >> (self.depth - 1 - level)) & 1, bits.zeros + ones, at - ones)
        return at


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols, by prefix doubling.

    Backward search counts patterns of up to ``depth`` symbols right with such an order.
    """
    n = len(text)
    rank = text.astype(np.int64)
    length = 1
    while True:
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(0, n - length)] = rank[length:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        steps = np.zeros(n, dtype=np.int64)
        steps[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(steps)
        length *= 2
        if length >= depth or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Backward search for many patterns at once.

    ``text`` holds symbols below ``sigma``; symbol 0 separates sequences and is in no pattern.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.order = suffix_order(text, depth)
        last = text[self.order - 1]  # the symbol before each suffix; the text is read as a circle
        self.matrix = WaveletMatrix(last, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.base = self.matrix.positions(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def extended(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns with one more symbol on the left."""
        start = self.first[symbols] - self.base[symbols]
        return start + self.matrix.positions(symbols, low), start + self.matrix.positions(symbols, high)

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched, low, high) for the windows of ``longest`` symbols at the given starts, matched from their right end.

        matched is the length of the longest suffix of the window that the index holds; low and high bound its suffixes.
        """
        low = np.zeros(len(starts), dtype=np.int64)
        high = np.full(len(starts), len(self.order), dtype=np.int64)
        matched = np.zeros(len(starts), dtype=np.int64)
        live = np.arange(len(starts))
        for step in range(longest - 1, -1, -1):
            a, b = self.extended(low[live], high[live], text[starts[live] + step])
            found = a < b
            live = live[found]
            low[live], high[live] = a[found], b[found]
            matched[live] += 1
        return matched, low, high
