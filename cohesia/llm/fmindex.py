"""FM-index over integer words, in numpy: suffix order, Burrows-Wheeler transform, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling. Symbol 0 ends a run; each of its occurrences sorts as a symbol of its own."""
    n = len(symbols)
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2 + n) + second
        order = np.argsort(key, kind="stable")
        steps = np.empty(n, np.int64)
        steps[0] = 0
        np.cumsum(key[order][1:] != key[order][:-1], out=steps[1:])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1 or width >= n:
            return order
        width *= 2


class WaveletRanks:
    """Wavelet tree in matrix layout: one bit vector per bit of the alphabet, with counts of ones up to each place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b) & 1
            self.levels.append((b, np.concatenate([[0], np.cumsum(ones)]).astype(np.int32), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before each ``place``."""
        start, end = np.zeros_like(place), place.copy()
        for b, ones, zeros in self.levels:
            one = (symbol >> b) & 1 == 1
            before, upto = ones[start], ones[end]
            start = np.where(one, zeros + before, start - before)
            end = np.where(one, zeros + upto, end - upto)
        return end - start

    def access(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each ``place``."""
        symbol, at = np.zeros(len(place), np.int64), place.copy()
        for b, ones, zeros in self.levels:
            one = ones[at + 1] - ones[at]
            symbol |= one.astype(np.int64) << b
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Index of ``symbols``, where 0 ends a run of words and the last symbol is 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        self.ranks = WaveletRanks(bwt.astype(np.int64), max(1, int(alphabet - 1).bit_length()))
        counts = np.bincount(symbols, minlength=alphabet)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        # every SAMPLEth position is kept, and every start of a run, so that no walk leaves its run
        sampled = order % SAMPLE == 0
        sampled |= bwt == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.kept = order[sampled]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of ``phrases``, all of one length, one per row: the half-open suffix ranges."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sampled) - 1, np.int64)
        live = np.arange(len(phrases))
        for column in phrases.T[::-1]:
            c = column[live]
            low[live] = self.before[c] + self.ranks.rank(c, low[live])
            high[live] = self.before[c] + self.ranks.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        gone = low >= high
        low[gone] = high[gone] = 0
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one and add the steps."""
        at, steps = places.copy(), np.zeros(len(places), np.int64)
        while True:
            walking = np.flatnonzero(self.sampled[at + 1] == self.sampled[at])
            if not len(walking):
                return self.kept[self.sampled[at]] + steps
            here = at[walking]
            c = self.ranks.access(here)
            at[walking] = self.before[c] + self.ranks.rank(c, here)
            steps[walking] += 1
