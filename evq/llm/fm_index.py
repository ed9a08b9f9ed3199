"""A compressed FM-index over sequences of numbers: a Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in words of 64 with running counts, for rank queries."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8)))
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class Wavelet:
    """A wavelet matrix: rank of any symbol before any place in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before low and before high."""
        start = np.zeros_like(low)
        for b, level, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            one = (symbol >> b & 1).astype(bool)
            s, l, h = level.ones(start), level.ones(low), level.ones(high)
            start = np.where(one, zeros + s, start - s)
            low = np.where(one, zeros + l, low - l)
            high = np.where(one, zeros + h, high - h)
        return low - start, high - start


class FMIndex:
    """Over sequences of symbols from 1; each sequence is closed by a 0, which no pattern has.

    Suffixes are sorted by their first depth symbols, which decides all patterns shorter than that.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank = text.astype(np.int64)
        size = 1
        while size < depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - size)] = rank[size:] + 1
            key = rank * (int(after.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
            rank, size = new, 2 * size
        self.order = np.argsort(rank, kind="stable")
        self.symbols = int(text.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.symbols))))
        self.transform = Wavelet(text[self.order - 1].astype(np.int64), max(1, int(self.symbols - 1).bit_length()))

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the ranges of the patterns with a symbol put before each."""
        l, h = self.transform.rank(symbol, low, high)
        return self.first[symbol] + l, self.first[symbol] + h

    def matched(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place that ends a pattern of text: symbols matched to the left of it (up to length) while more
        than one place of the index has them, and the range of what was matched. A pattern that occurs once only is
        given up there, with its matched length so far."""
        done = np.ones(len(ends), np.int64)
        low, high = self.first[text[ends]].copy(), self.first[text[ends] + 1].copy()
        live = np.flatnonzero(high - low > 1)
        for k in range(1, length):
            l, h = self.extended(text[ends[live] - k].astype(np.int64), low[live], high[live])
            go = h - l > 1
            live = live[go]
            low[live], high[live] = l[go], h[go]
            done[live] = k + 1
            if not len(live):
                break
        return done, low, high
