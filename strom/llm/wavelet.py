"""Wavelet matrix over an array of distinct or repeated numbers, asked many queries at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Answers order queries over slices of ``values`` (0 <= value < ``limit``).

    Each level holds one bit of every value, packed, with a running count per 64 bits, so it takes about 12 bits a value and level.
    All queries of a call go down the levels together.
    """

    def __init__(self, values: np.ndarray, limit: int):
        self.size = len(values)
        self.bits = max(1, int(limit - 1).bit_length()) if limit > 1 else 1
        self.levels = []
        current = values.astype(np.int64)
        for bit in range(self.bits - 1, -1, -1):
            ones = (current >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(self.size // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, self.size - int(ones.sum())))
            current = np.concatenate([current[~ones], current[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def count_below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each slice [low, high) are less than ``bound``."""
        low, high = low.copy(), high.copy()
        found = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            one = (bound >> (self.bits - 1 - level) & 1).astype(bool)
            found += np.where(one, (high - b) - (low - a), 0)
            zeros = self.levels[level][2]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return np.where(bound >> self.bits > 0, high - low + found, found)

    def smallest(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The ``nth`` (from 0) smallest value of each slice [low, high), which must hold that many."""
        low, high, nth = low.copy(), high.copy(), nth.copy()
        value = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            zeros_here = (high - b) - (low - a)
            one = nth >= zeros_here
            nth = np.where(one, nth - zeros_here, nth)
            value = value << 1 | one
            zeros = self.levels[level][2]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return value
