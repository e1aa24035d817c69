"""An FM-index over a sequence of small integers: wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions in suffix order, by rank doubling; every 0 is a separator, smaller than all symbols and unlike any other 0."""
    n = len(symbols)
    zeros = np.cumsum(symbols == 0)
    rank = np.where(symbols == 0, zeros - 1, symbols + (zeros[-1] if n else 0)).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while n:
        ranked = rank[order]
        new = np.zeros(n, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        groups = np.cumsum(new)
        rank[order] = groups
        if groups[-1] == n - 1 or step > n:
            return order
        # only members of groups of several are sorted again, by the rank of what follows them
        alone = np.append(new[1:], True) & (new | (np.arange(n) == 0))
        open_rows = np.flatnonzero(~alone)
        follow = np.zeros(len(open_rows), np.int64)
        after = order[open_rows] + step
        inside = after < n
        follow[inside] = rank[after[inside]] + 1
        sub = np.lexsort((follow, groups[open_rows]))
        order[open_rows] = order[open_rows][sub]
        key_g, key_f = groups[open_rows][sub], follow[sub]
        split = np.zeros(len(sub), bool)
        split[1:] = (key_g[1:] != key_g[:-1]) | (key_f[1:] != key_f[:-1])
        new[open_rows] = split | new[open_rows]
        rank[order] = np.cumsum(new)
        step *= 2
    return order


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            sums = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=sums[1:])
            self.ones.append(sums)
            self.zeros.append(len(symbols) - int(sums[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        low, high = np.zeros_like(before), before
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank before it."""
        symbol, low, high = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[high + 1] - ones[high]
            symbol = symbol * 2 + bit
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            high = np.where(bit == 1, zeros + ones[high], high - ones[high])
        return symbol, high - low


class FMIndex:
    """Index of a text of symbols from 1 to top; each 0 in it separates passages, and no pattern may hold one."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = 8):
        symbols = np.concatenate(([0], symbols)).astype(np.int64)
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.matrix = WaveletMatrix(symbols[order - 1], max(1, int(top).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        # a passage's first position is always sampled, so that no walk crosses a separator
        kept = (order % sample == 0) | (symbols[order - 1] == 0)
        self.kept_rank = np.concatenate(([0], np.cumsum(kept)))
        self.kept_at = order[kept]
        self.kept = kept

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the patterns, rows padded beyond their lengths."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for step in range(int(lengths.max()) if len(lengths) else 0):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step]
            low[live] = self.first[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by stepping back to a sampled one."""
        rows = rows.copy()
        walked = np.zeros(len(rows), np.int64)
        open_rows = np.flatnonzero(~self.kept[rows])
        while len(open_rows):
            symbol, rank = self.matrix.access(rows[open_rows])
            rows[open_rows] = self.first[symbol] + rank
            walked[open_rows] += 1
            open_rows = open_rows[~self.kept[rows[open_rows]]]
        return self.kept_at[self.kept_rank[rows]] + walked - 1
