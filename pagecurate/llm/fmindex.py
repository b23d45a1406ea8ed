"""A compressed FM-index over a text of integers, with numpy.

The Burrows-Wheeler transform is kept as a wavelet matrix: one bit per symbol
and level, packed into 64-bit words with a running count per word. Backward
search runs for many patterns at once: a step of all of them is a few array
operations per level.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the sorted suffixes, by prefix doubling; after each round
    only suffixes that still tie are sorted further."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # beyond the end sorts first
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    # the rank of a suffix is the place of the first of its group
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~(new & np.append(new[1:], True))
    step = 1
    while tied.any():
        places = np.flatnonzero(tied)
        at = order[places]
        first = rank[at]
        second = rank[np.minimum(at + step, n)]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[places] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[at] = places[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied[places[new & np.append(new[1:], True)]] = False
        step *= 2
    return order


class FMIndex:
    """Counts of patterns in a text of symbols 0 <= c < ``symbols``. Symbol 0
    separates pieces and ends the text; patterns do not hold it."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)
        self.n = len(text)
        order = suffix_array(text)
        column = text[order - 1]  # the symbol before each suffix; 0 before the first
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        current = column
        for level in reversed(range(self.levels)):
            bit = ((current >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[:self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(self.n - int(ones.sum()))
            current = np.concatenate([current[~bit], current[bit]])
        # where each symbol's block begins after the last level
        self.block = np.zeros(symbols, np.int64)
        values, at = np.unique(current, return_index=True)
        self.block[values] = at

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the intervals [low, high) of suffixes that begin
        with some strings become those of the strings with ``symbol`` in front."""
        k = len(symbol)
        i = np.concatenate([low, high])
        c = np.concatenate([symbol, symbol])
        for level in range(self.levels):
            ones = self._ones(level, i)
            bit = (c >> (self.levels - 1 - level)) & 1
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        i += self.first[c] - self.block[c]
        return i[:k], i[k:]


def repeated_runs(index: FMIndex, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs [a, b) of at least ``least`` symbols inside the pieces [starts,
    ends) of the indexed text that occur at least twice in it; every repeated
    window of ``least`` symbols of a piece lies in one of them.

    Matching statistics from the right, all pieces in step: from an end ``e``
    the match grows to the left while it occurs twice. Where it stops at ``i``,

    * a long match is reported. Windows not inside it begin before ``i``, so the
      next end is ``i - 1 + least``;
    * a short one rules out the windows over [i - 1, e), and all others end
      before ``e``. It is then asked whether [i - 1, i + 1) alone is unique: if
      so the next end is ``i``, otherwise it is ``e - 1``.
    """
    out_a, out_b = [], []
    fits = ends - starts >= least
    left, end = starts[fits].astype(np.int64), ends[fits].astype(np.int64)
    at = end.copy()
    low, high = np.zeros(len(left), np.int64), np.full(len(left), index.n, np.int64)
    asked, back = np.full(len(left), -1, np.int64), np.zeros(len(left), np.int64)
    while len(left):
        new_low, new_high = index.extend(text[at - 1], low, high)
        grown = new_high - new_low >= 2
        at = at - grown
        search = asked < 0
        stop = np.where(search, ~grown | (at == left), ~grown | (at == asked))
        low, high = np.where(stop, 0, new_low), np.where(stop, index.n, new_high)
        if not stop.any():
            continue
        match = end - at
        long = stop & search & (match >= least)
        out_a.append(at[long])
        out_b.append(end[long])
        done = stop & search & grown  # the match reaches the left end: nothing is left
        ask = stop & search & ~grown & ~long & (match >= 2)
        answer = stop & ~search
        next_end = np.select([long, ask, answer & grown, answer], [at - 1 + least, at + 1, back, asked + 1], end - 1)
        back = np.where(ask, end - 1, back)
        asked = np.where(ask, at - 1, np.where(answer, -1, asked))
        end = np.where(stop, next_end, end)
        at = np.where(stop, end, at)
        done |= (asked < 0) & (end - left < least)
        if done.any():
            left, end, at, low, high, asked, back = (v[~done] for v in (left, end, at, low, high, asked, back))
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)
