"""An FM-index over word ids: wavelet matrix, backward search, matching intervals.

The index is built for one shard inside one task and searched by many texts at once:
every numpy operation advances all texts by one word.  Its text is a list of segments,
each closed by a separator of its own, so no match runs over a segment's end.

What is kept of a shard of n words and s different words is the wavelet matrix of its
Burrows-Wheeler transform (n log2(s) bits and a counter for each 64 of them) and a payload
for each row; the suffix array is dropped once the transform is made.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


class WaveletMatrix:
    """Rank queries on a sequence of symbols, level by level from the highest bit on."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.shifts = range(max(int(alphabet - 1).bit_length(), 1) - 1, -1, -1)
        self.bits, self.before, self.zeros = [], [], []
        for shift in self.shifts:
            bit = (symbols >> shift & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)  # one more than needed: a rank may ask for the end
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64))).astype(np.uint32))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among the occurrences of ``symbol``, plus a start that is the symbol's own."""
        for shift, bits, before, zeros in zip(self.shifts, self.bits, self.before, self.zeros, strict=True):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word].astype(np.int64) + np.bitwise_count(bits[word] & below)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix array, ranks by the first d words, d), d being the largest power of two within ``depth``.

    Prefix doubling; separators are told apart by their places.
    """
    n = len(text)
    closing = text == SEPARATOR
    rank = np.where(closing, np.cumsum(closing) - 1, text + (int(closing.sum()) - 1))
    rank = np.unique(rank, return_inverse=True)[1]
    reach, known, at_depth = 1, rank, 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-reach] = rank[reach:]
        key = rank * n + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        reach *= 2
        if reach <= depth:
            known, at_depth = rank, reach
        if rank[order[-1]] == n - 1 and reach * 2 > depth:
            return order, known, at_depth
        if reach >= n:
            return order, known, at_depth


class FMIndex:
    """An index of segments; ``payload`` is one number a segment, of which a match reports the least."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, payload: np.ndarray, threshold: int) -> None:
        """``words``: ids from 1 on, all segments in a row; ``ends``: where each segment ends among them."""
        self.threshold = threshold
        lengths = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(ends)), lengths + 1)
        text = np.zeros(len(owner), np.int64)
        closing = np.cumsum(lengths + 1) - 1
        inside = np.ones(len(text), bool)
        inside[closing] = False
        text[inside] = words
        order, known, depth = suffix_array(text, threshold)
        alphabet = int(words.max(initial=0)) + 1
        self.rows, self.alphabet = len(text), alphabet
        self.matrix = WaveletMatrix(text[order - 1], alphabet)
        counts = np.bincount(text, minlength=alphabet)
        symbols = np.arange(alphabet)
        self.shift = np.cumsum(counts) - counts - self.matrix.place(symbols, np.zeros(alphabet, np.int64))
        # rows that agree in their first ``threshold`` words form one interval, and hold its least payload
        there = np.minimum(order + (threshold - depth), len(text) - 1)
        heads = np.stack((known[order], known[there]))
        starts = np.flatnonzero(np.concatenate(([True], (heads[:, 1:] != heads[:, :-1]).any(axis=0))))
        least = np.minimum.reduceat(payload[owner[order]], starts)
        self.least = np.repeat(least, np.diff(starts, append=len(text)))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of backward search: the intervals of what begins with ``symbol`` and goes on as before."""
        both = np.concatenate((symbol, symbol))
        out = self.matrix.place(both, np.concatenate((low, high))) + self.shift[both]
        return out[: len(symbol)], out[len(symbol) :]

    def matches(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word of the streamed texts a row of the index whose suffix begins with the ``threshold`` words from there; -1 without one.

        ``words`` are ids of the index, 0 for words that it lacks.  A text is read from its
        end, a word a step, and keeps its interval as long as the match grows.  Where it ends,
        the longest end that can still hold a match of ``threshold`` words is tried next, which
        needs no parent links.
        """
        out = np.full(len(words), -1, np.int64)
        begin, end = np.concatenate(([0], ends[:-1])), ends.copy()
        alive = np.flatnonzero(end - begin >= self.threshold)
        begin, end = begin[alive], end[alive]
        at, low, high = end - 1, np.zeros(len(end), np.int64), np.full(len(end), self.rows)
        while len(at):
            symbol = words[at]
            low, high = self.step(symbol, low, high)
            failed = (symbol == SEPARATOR) | (low >= high)
            long = ~failed & (end - at >= self.threshold)
            out[at[long]] = low[long]
            if failed.any():
                end = np.where(failed, np.minimum(at, end - 1 - self.threshold) + self.threshold, end)
                low, high = np.where(failed, 0, low), np.where(failed, self.rows, high)
            at = np.where(failed, end, at) - 1
            going = (at >= begin) & (end - begin >= self.threshold)
            begin, end, at, low, high = begin[going], end[going], at[going], low[going], high[going]
        return out
