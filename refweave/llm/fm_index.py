"""FM-index over integer texts: suffix array, wavelet matrix, backward search and sampled locating, all vectorised."""

from __future__ import annotations

import numpy as np


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``ids`` (non-negative) in order; the end of the text is below every symbol.

    Prefix doubling; each round sorts only the suffixes that are still equal to a neighbour.
    """
    n = len(ids)
    if not n:
        return np.empty(0, np.int64)
    bits = max(1, int(ids.max() + 1).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        if k < n:
            key[: n - k] += ids[k:] + 1
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=starts[1:])
    slot = np.arange(n)
    head = np.maximum.accumulate(np.where(starts, slot, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    single = starts & np.append(starts[1:], True)
    open_ = np.flatnonzero(~single)
    k = width
    while len(open_):
        at = sa[open_]
        follow = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        pair = rank[at] * np.int64(n + 1) + follow
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        sa[open_] = at
        starts = np.ones(len(at), bool)
        starts[1:] = pair[1:] != pair[:-1]
        head = open_[np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))]
        rank[at] = head
        open_ = open_[~(starts & np.append(starts[1:], True))]
        k *= 2
    return sa


class WaveletMatrix:
    """Rank and access over a sequence of integers, by one bit vector a bit of the alphabet."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(seq)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = seq
        for level in range(bits - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            s = np.concatenate((s[~bit], s[bit]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``upto``, elementwise."""
        lo, hi = np.zeros_like(upto), upto
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at ``at``, its occurrences before ``at``)."""
        pos, lo, symbol = at, np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[pos], ones[lo]
            bit = ones[pos + 1] > a
            symbol = (symbol << 1) | bit
            pos, lo = np.where(bit, zeros + a, pos - a), np.where(bit, zeros + b, lo - b)
        return symbol, pos - lo


class FMIndex:
    """Finds all places of many phrases in a text of integers in [0, size)."""

    def __init__(self, ids: np.ndarray, size: int, sample: int = 4) -> None:
        self.n, self.size = len(ids), size
        sa = suffix_array(ids)
        # Row 0 is the empty suffix; the others follow. The symbol before the whole text is size, which no phrase has.
        rows = np.concatenate(([self.n], sa))
        before = np.where(rows > 0, ids[np.maximum(rows - 1, 0)] if self.n else 0, size)
        self.wavelet = WaveletMatrix(before.astype(np.int64), max(1, int(size).bit_length()))
        counts = np.bincount(ids, minlength=size) if self.n else np.zeros(size, np.int64)
        self.first = np.concatenate(([1], 1 + np.cumsum(counts)))  # row where suffixes beginning with a symbol begin
        marked = rows % sample == 0
        self.marked = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(marked, out=self.marked[1:])
        self.sampled = rows[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: one a row, all of one length, symbols in [0, size). The half-open range of rows of each."""
        last = phrases[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        live = np.flatnonzero(lo < hi)
        for k in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[live, k]
            l, h = self.wavelet.rank(c, lo[live]), self.wavelet.rank(c, hi[live])
            lo[live], hi[live] = self.first[c] + l, self.first[c] + h
            live = live[l < h]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which range, position in the text) of every row of the ranges: steps back to a sampled suffix."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        row = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(which)) if len(which) else which
        pos = np.full(len(which), -1, np.int64)
        todo, steps = np.arange(len(which)), 0
        while len(todo):
            r = row[todo]
            hit = self.marked[r + 1] > self.marked[r]
            pos[todo[hit]] = self.sampled[self.marked[r[hit]]] + steps
            todo = todo[~hit]
            symbol, rank = self.wavelet.access_rank(row[todo])
            row[todo] = self.first[symbol] + rank
            steps += 1
        return which, pos
