"""A compressed FM-index over words, and matching statistics of many texts at once by backward search.

The indexed texts are one sequence of word numbers, each text after a separator. Rows are its suffixes,
sorted by their first DEPTH words (prefix doubling): that is enough for patterns of up to DEPTH words,
as every count that a backward step takes is over rows told apart by fewer words. Of the sorted rows the
index keeps the preceding words (the BWT) as a wavelet tree of bit-packed levels, in the matrix layout,
with a rank directory a 64-bit word: about 1.5 bits for each of the log2 of the vocabulary's size
levels. The lengths of common prefixes of neighbouring rows, up to ``width``, stand beside it, with their
minima over blocks of powers of two, which shorten patterns at the right end.

The search goes through texts from right to left, all in lockstep: each text has a pattern, the rows that
begin with it, and its length. A step puts a word before the pattern; while no row has it, the pattern
gives up words at the right end until one does. What is left is the longest prefix of the text from that
word on which occurs in the index: its matching statistic, counted up to ``width``.
"""

from __future__ import annotations

import numpy as np

#: Words by which rows are sorted; the widest pattern.
DEPTH = 64


class Bits:
    """A bit vector with a directory for rank: bits in 64-bit words, and ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Rank of any symbol in a sequence: one bit vector a level, most significant bit first."""

    def __init__(self, symbols: np.ndarray, count: int) -> None:
        self.levels, self.zeros = [], []
        for shift in range(max(1, (count - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(ones)))
            self.zeros.append(len(ones) - int(ones.sum()))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the rank of each symbol before each place begins counting in the last level."""
        at = at.astype(np.int64)
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(at)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at


def suffix_order(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, common): the suffixes sorted by their first DEPTH words, and the common prefix of each row with the one before, up to width."""
    n, ranks, h = len(text), [text.astype(np.int64)], 1
    order = None
    while h < DEPTH:
        now = ranks[-1]
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - h)] = now[h:] + 1
        key = now * (int(now.max()) + 2) + after
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        ranks.append(rank)
        h *= 2
        if fresh[-1] == n - 1:
            break
    common, a, b = np.zeros(n, dtype=np.int64), order[:-1], order[1:]
    length = np.zeros(n - 1, dtype=np.int64)
    for i in range(len(ranks) - 2, -1, -1):  # the last rank is the order's own
        left, right = a + length, b + length
        inside = (left < n) & (right < n)
        same = inside & (ranks[i][np.minimum(left, n - 1)] == ranks[i][np.minimum(right, n - 1)])
        length += same << i
    common[1:] = length
    return order, np.minimum(common, width).astype(np.int8)


class FMIndex:
    """The index of a list of word-number sequences; numbers from 1 to count - 1."""

    def __init__(self, texts: list[np.ndarray], count: int, width: int) -> None:
        if width >= DEPTH:
            raise ValueError(f"patterns have fewer than {DEPTH} words")
        separator = np.zeros(1, dtype=np.int64)
        text = np.concatenate([x for t in texts for x in (t, separator)] or [separator])
        if len(text) == 1:
            text = np.zeros(2, dtype=np.int64)
        self.n, self.width = len(text), width
        order, common = suffix_order(text, width)
        self.tree = WaveletTree(text[order - 1], count)
        before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=count))[:-1]))
        every = np.arange(count, dtype=np.int64)
        self.base = before - self.tree.place(every, np.zeros(count, dtype=np.int64))
        # minima of runs of 2 ** k common prefixes that begin at a row, for the first rows of wider runs
        self.lowest = [np.append(common, np.int8(-1))]
        while 2 << len(self.lowest) <= 2 * self.n:
            half, step = self.lowest[-1], 1 << (len(self.lowest) - 1)
            wide = np.full(len(half), -1, dtype=np.int8)
            wide[: len(half) - step] = np.minimum(half[: len(half) - step], half[step:])
            self.lowest.append(wide)

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each pattern with a symbol put before it."""
        both = self.tree.place(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        first = self.base[symbols]
        return first + both[: len(low)], first + both[len(low) :]

    def widen(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have the first ``depth`` words of a pattern in common with its rows."""
        low, high = low.copy(), high.copy()
        for k in range(len(self.lowest) - 1, -1, -1):
            run = self.lowest[k]
            more = run[high] >= depth  # rows high to high + 2 ** k - 1 belong too
            high[more] += 1 << k
            start = low - (1 << k) + 1
            less = (start > 0) & (run[np.maximum(start, 0)] >= depth)
            low[less] -= 1 << k
        return low, high

    def statistics(self, texts: np.ndarray) -> np.ndarray:
        """The matching statistic of each place in a matrix of word numbers, a column a text; -1 is a word that the index lacks, or none."""
        steps, many = texts.shape
        found = np.zeros(texts.shape, dtype=np.int8)
        low, high, length = np.zeros(many, dtype=np.int64), np.full(many, self.n, dtype=np.int64), np.zeros(many, dtype=np.int64)
        for at in range(steps - 1, -1, -1):
            symbols = texts[at]
            full = np.flatnonzero((length == self.width) & (symbols >= 0))
            if len(full):
                low[full], high[full] = self.widen(low[full], high[full], np.full(len(full), self.width - 1))
                length[full] = self.width - 1
            gone = symbols < 0
            low[gone], high[gone], length[gone] = 0, self.n, 0
            open_ = np.flatnonzero(~gone)
            while len(open_):
                new_low, new_high = self.step(symbols[open_], low[open_], high[open_])
                hit = new_high > new_low
                done = open_[hit]
                low[done], high[done] = new_low[hit], new_high[hit]
                length[done] += 1
                open_ = open_[~hit]
                open_ = open_[length[open_] > 0]
                if len(open_):  # the longest shorter prefix that more rows have
                    edge = self.lowest[0]
                    shorter = np.maximum(np.maximum(edge[low[open_]], edge[high[open_]]), 0).astype(np.int64)
                    low[open_], high[open_] = self.widen(low[open_], high[open_], shorter)
                    length[open_] = shorter
                    all_rows = open_[shorter == 0]
                    low[all_rows], high[all_rows] = 0, self.n
            found[at] = length
        return found
