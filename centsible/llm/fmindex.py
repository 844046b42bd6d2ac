"""An FM-index over sequences of small integers, with NumPy: suffix order, wavelet ranks, sampled positions.

The text is many sequences, each closed by the symbol 0. Closing symbols count as different and ordered
by position, so no comparison reaches into the next sequence and the order of suffixes is total.
"""

from __future__ import annotations

import numpy as np

from centsible.llm.arrays import ranges

SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in ascending order, by prefix doubling over the ties that are left."""
    n = len(text)
    ends = text == 0
    symbol = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    order = np.argsort(symbol, kind="stable")
    ordered = symbol[order]
    opens = np.ones(n, bool)
    opens[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)  # where a suffix's group of equals begins in the order
    rank[order] = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    width = 1
    size = np.diff(np.append(np.flatnonzero(opens), n))
    tied = order[np.repeat(size > 1, size)]
    while len(tied):
        # tied suffixes are at least ``width`` long, so the second half begins inside the text
        second = rank[np.minimum(tied + width, n - 1)]
        by = np.lexsort((second, rank[tied]))
        tied, second = tied[by], second[by]
        group = rank[tied]
        first = np.ones(len(tied), bool)
        first[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(first)[np.cumsum(first) - 1]
        order[group + np.arange(len(tied)) - begin] = tied
        opens = first.copy()
        opens[1:] |= second[1:] != second[:-1]
        heads = np.flatnonzero(opens)
        rank[tied] = (group + np.arange(len(tied)) - begin)[heads][np.cumsum(opens) - 1]
        size = np.diff(np.append(heads, len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        width *= 2
    return order


class WaveletRanks:
    """rank(c, i): how often symbol c occurs before position i, by one bit of c per level."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            before = np.zeros(len(current) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(current) - int(before[-1]))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for depth, (before, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.levels - 1 - depth)) & 1 == 1
            begin = np.where(one, zeros + before[begin], begin - before[begin])
            at = np.where(one, zeros + before[at], at - before[at])
        return at - begin


class FmIndex:
    def __init__(self, text: np.ndarray, largest: int):
        """``text``: symbols 1 to ``largest`` in sequences that each end with 0."""
        order = suffix_order(text)
        self.bwt = text[order - 1]  # before the first position stands the closing symbol at the end
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=largest + 1))))
        self.ranks = WaveletRanks(self.bwt, largest)
        # kept: every SAMPLE-th position and where a sequence begins (a walk to the left cannot go on there)
        kept = (order % SAMPLE == 0) | (self.bwt == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.kept_position = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of a matrix at once: the range of suffixes that begin with each."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            low[live] = self.less[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.ranks.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, position) of every occurrence, by walking left to a kept position."""
        count = high - low
        which, at = np.repeat(np.arange(len(low)), count), ranges(low, count)
        position = np.empty(len(at), np.int64)
        live, steps = np.arange(len(at)), 0
        while len(live):
            here = at[live]
            found = self.kept_before[here + 1] > self.kept_before[here]
            position[live[found]] = self.kept_position[self.kept_before[here[found]]] + steps
            live, here = live[~found], here[~found]
            symbol = self.bwt[here]
            at[live] = self.less[symbol] + self.ranks.rank(symbol, here)
            steps += 1
        return which, position
