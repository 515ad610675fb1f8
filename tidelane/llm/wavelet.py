"""A wavelet matrix over small alphabets: how often symbols occur before any position, in a few word look-ups."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with the number of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """``symbols`` below 2**bits, one bit vector a level from the highest bit down; a level's zeros go before its ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.bits, self.levels = len(symbols), bits, []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append(BitVector(bit))
            if level:
                ones = bit.view(bool)
                symbols = np.concatenate((symbols[~ones], symbols[ones]))
        self.first = [int(self._descend(s, np.zeros(1, np.int64))[0]) for s in range(1 << bits)]

    def _descend(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(self.levels):
            ones = level.ones(at)
            at = level.zeros + ones if symbol >> (self.bits - 1 - i) & 1 else at - ones
        return at

    def rank(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """Occurrences of any of ``symbols`` in the first ``at`` places."""
        return sum((self._descend(s, at) - self.first[s] for s in symbols), np.zeros(len(at), np.int64))

    def locate(self, symbols: tuple[int, ...], start: np.ndarray, end: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The smallest place from ``start`` on before which ``count`` of ``symbols`` lie since ``start``, by bisection on
        ranks; ``end`` where there are fewer."""
        low, high, wanted = start.copy(), end.copy(), self.rank(symbols, start) + count
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.rank(symbols, middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low
