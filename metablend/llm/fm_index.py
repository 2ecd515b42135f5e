"""FM-index over a sequence of symbol ids: wavelet-matrix ranks, backward search, sampled positions.

Built per shard of the training texts (see ``decontaminate``).  All steps are
array operations; searches run for many patterns at the same time.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling.

    After each round only suffixes whose rank is still shared are sorted again,
    so long repeats cost their own length, not the shard's.
    """
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    rank, open_ = _ranks(order, rank[order], np.arange(n), n)
    step = 1
    while open_.any():
        slots = np.flatnonzero(open_)           # places in the order that share their rank
        rows = order[slots]
        nxt = rows + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        first = rank[rows]
        by = np.lexsort((second, first))
        order[slots] = rows = rows[by]
        first, second = first[by], second[by]
        # rank: the first place of the run of equal (first, second)
        new = np.empty(len(rows), bool)
        new[0] = True
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        run = np.maximum.accumulate(np.where(new, slots, 0))
        rank[rows] = run
        last = np.empty(len(rows), bool)
        last[-1] = True
        last[:-1] = new[1:]
        open_[slots] = ~(new & last)
        step *= 2
    return order


def _ranks(order: np.ndarray, keys: np.ndarray, slots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = keys[1:] != keys[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    last = np.empty(n, bool)
    last[-1:] = True
    last[:-1] = new[1:]
    return rank, ~(new & last)


class WaveletMatrix:
    """Rank of any symbol in any prefix of a sequence, one bit per level."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(np.int32)
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.seq = seq

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol[i]`` in the first ``at[i]`` elements."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit == 1, zeros + lo1, lo - lo1)
            hi = np.where(bit == 1, zeros + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    """Index of ``text`` (ids below ``n_symbols``; id 0 is the end mark and never searched)."""

    def __init__(self, text: np.ndarray, n_symbols: int, every: int = SAMPLE_EVERY):
        text = np.concatenate([text.astype(np.int64), [0]])
        sa = suffix_array(text)
        self.bwt = text[sa - 1]                       # sa == 0 wraps to the end mark
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.wavelet = WaveletMatrix(self.bwt, n_symbols)
        # starts of runs are sampled too, so no walk steps over an end mark
        sampled = (sa % every == 0) | (self.bwt == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = sa[sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of equally long patterns (one per row of ``patterns``), by backward search."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in range(patterns.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = patterns[live, k]
            a = self.less[c] + self.wavelet.rank(c, lo[live])
            b = self.less[c] + self.wavelet.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: walk back to a sampled suffix position."""
        pos = np.full(len(rows), -1, np.int64)
        at, walked, live = rows.copy(), 0, np.arange(len(rows))
        while len(live):
            hit = self.sampled[at]
            pos[live[hit]] = self.samples[self.sample_rank[at[hit]]] + walked
            live, at = live[~hit], at[~hit]
            c = self.bwt[at]
            at = self.less[c] + self.wavelet.rank(c, at)
            walked += 1
        return pos
