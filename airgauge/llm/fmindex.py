"""FM-index over sequences of numbered words: wavelet-matrix ranks and sampled positions."""

from __future__ import annotations

import numpy as np

from airgauge.llm.bytewise import ragged

SAMPLE = 16  # every such text position is kept, and every position after a separator


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; each 0 is a separator, smaller than all else and than later ones."""
    n = len(text)
    separators = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        change = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = change
        if change[-1] == n - 1:
            return order
        # Only suffixes that still share a rank are sorted again.
        open_ = np.zeros(n, bool)
        tie = change[1:] == change[:-1]
        open_[1:] |= tie
        open_[:-1] |= tie
        at = np.flatnonzero(open_)
        tied = order[at]
        following = np.zeros(len(tied), np.int64)
        inside = tied + step < n
        following[inside] = rank[tied[inside] + step] + 1
        inner = np.lexsort((following, rank[tied]))
        order[at] = tied[inner]
        key = np.zeros(n, np.int64)
        key[at] = following[inner]
        # New ranks: by old rank, then by what follows.
        old = rank[order]
        fresh = np.concatenate([[0], np.cumsum((old[1:] != old[:-1]) | (key[1:] != key[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2


class WaveletMatrix:
    """Counts of a symbol before a position, by one bit of the symbol at a time."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros_like(ends), ends
        for i in range(self.bits):
            one = (symbols >> (self.bits - 1 - i)) & 1 == 1
            ones = self.ones[i]
            low = np.where(one, self.zeros[i] + ones[low], low - ones[low])
            high = np.where(one, self.zeros[i] + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Index of a text of symbols from 1 to ``symbols``, with 0 after every run."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        self.last = text[order - 1].astype(np.int64)  # the symbol before each suffix
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.ranks = WaveletMatrix(self.last, max(1, int(symbols).bit_length()))
        self.sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.known = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each pattern (left-aligned, 0 beyond its length)."""
        count = len(self.last)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), count)
        alive = np.arange(len(patterns))
        for back in range(1, int(lengths.max()) + 1 if len(lengths) else 1):
            alive = alive[(lengths[alive] >= back) & (high[alive] > low[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, lengths[alive] - back]
            base = self.first[symbol]
            low[alive] = base + self.ranks.rank(symbol, low[alive])
            high[alive] = base + self.ranks.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(~self.sampled[rows])
        while len(left):
            symbol = self.last[rows[left]]
            rows[left] = self.first[symbol] + self.ranks.rank(symbol, rows[left])
            steps[left] += 1
            left = left[~self.sampled[rows[left]]]
        return self.samples[self.known[rows]] + steps

    def occurrences(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, text position) of every occurrence."""
        low, high = self.search(patterns, lengths)
        sizes = np.maximum(high - low, 0)
        return np.repeat(np.arange(len(patterns)), sizes), self.locate(ragged(low, sizes))
