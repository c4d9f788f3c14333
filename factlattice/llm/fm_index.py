"""An FM-index over a sequence of small integers: wavelet matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step if step < n else 0] = rank[step:] + 1
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        ordered = pair[order]
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access in a sequence, one bit of the symbols a level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        # A shard has far fewer than 2^31 symbols: half the width of places will do for counts.
        seq = seq.astype(np.int32)
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            bit = ((symbol >> level) & 1).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Counts and finds phrases of one sequence. Symbols are 1 and up; 0 ends the sequence."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        seq = np.concatenate((seq.astype(np.int64), [0]))
        order = suffix_array(seq)
        self.n = len(seq)
        last = seq[order - 1]
        self.tree = WaveletMatrix(last, symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        kept = order % sample == 0
        self.kept, self.kept_rank = kept, np.cumsum(kept) - kept
        self.places = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase, by backward search; one phrase a row."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in reversed(range(phrases.shape[1])):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            symbol = phrases[live, k]
            lo[live] = self.before[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.tree.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of suffixes: steps back from each to the next sampled one."""
        steps, out, live = np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            done = self.kept[rows[live]]
            out[live[done]] = self.places[self.kept_rank[rows[live[done]]]] + steps[live[done]]
            live = live[~done]
            symbol = self.tree.access(rows[live])
            rows[live] = self.before[symbol] + self.tree.rank(symbol, rows[live])
            steps[live] += 1
        return out
