"""A compressed FM-index over integer sequences, searched for many patterns at a time.

Suffixes are sorted to ``depth`` symbols, which is all that patterns of up to
``depth`` symbols need.  The Burrows-Wheeler transform stands in a wavelet
matrix: one bit vector a level, packed in 64-bit words with counts per word.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, now = [], symbols
        for k in range(bits - 1, -1, -1):
            one = (now >> k) & 1
            self.levels.append((k, vector := BitVector(one), vector.size - vector.ones))
            now = np.concatenate((now[one == 0], now[one == 1]))

    def rank(self, symbol: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``start`` and ``stop``, less those that sort before it."""
        origin = np.zeros_like(start)
        for k, vector, zeros in self.levels:
            one = ((symbol >> k) & 1).astype(bool)
            moved = []
            for at in (origin, start, stop):
                ones = vector.rank(at)
                moved.append(np.where(one, zeros + ones, at - ones))
            origin, start, stop = moved
        return start - origin, stop - origin


class FMIndex:
    """``symbols`` are 1 and up; 0 ends a sequence.  ``owner`` is a number per place, whose least is asked for."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, depth: int, table: int):
        n = len(symbols)
        self.symbols, self.table = symbols, table
        rank, have, kept = symbols.astype(np.int64), 1, None
        while have < depth:
            if have <= table:
                kept, self.table = rank, have
            step = min(have, depth - have)
            beyond = np.zeros(n, np.int64)
            beyond[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (int(beyond.max(initial=0)) + 1) + beyond, return_inverse=True)[1].reshape(-1)
            have += step
        order = np.argsort(rank, kind="stable")  # the suffix array
        self.owner = owner[order]
        sigma = int(symbols.max(initial=0)) + 1
        self.first = np.searchsorted(symbols[order], np.arange(sigma + 1))  # suffixes before each symbol's
        self.bwt = WaveletMatrix(symbols[order - 1] if n else symbols, max(1, (sigma - 1).bit_length()))
        # the table of short patterns: where the suffixes that share their first `table` symbols begin and end
        short = kept[order]
        new = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1]))) if n else np.empty(0, np.int64)
        self.short, of = kept, np.zeros(int(kept.max(initial=0)) + 2, np.int64)
        of[short[new]] = np.arange(len(new))
        self.group, self.begin, self.end = of, new, np.concatenate((new[1:], [n]))

    def search(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array intervals of the patterns of ``length`` symbols that begin at ``places`` of the text.

        The table gives the interval of a pattern's last symbols, backward steps prepend the others.
        An interval of one suffix is the pattern's own and can't shrink; its search ends there.
        """
        group = self.group[self.short[places + length - self.table]]
        start, stop = self.begin[group], self.end[group]
        for k in range(length - self.table - 1, -1, -1):
            live = np.flatnonzero(stop - start > 1)
            if not len(live):
                break
            symbol = self.symbols[places[live] + k]
            low, high = self.bwt.rank(symbol, start[live], stop[live])
            start[live], stop[live] = self.first[symbol] + low, self.first[symbol] + high
        return start, stop

    def least_owner(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The least owner in each interval; the intervals are not empty."""
        if not len(start):
            return np.empty(0, self.owner.dtype)
        pairs, back = np.unique(np.stack((start, stop), 1), axis=0, return_inverse=True)
        padded = np.concatenate((self.owner, [np.iinfo(np.int64).max]))
        return np.minimum.reduceat(padded, pairs.reshape(-1))[::2][back.reshape(-1)]
