"""FM-index over an integer text: suffix sorting by prefix doubling, a wavelet matrix over the
Burrows-Wheeler transform, backward search and location by sampled suffix positions.

Symbol 0 is a separator. Each separator sorts as a symbol of its own, in text order, so no match spans
one and suffixes differ once they reach one. Everything works on whole numpy arrays: a search
runs all phrases at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 16


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Place of each suffix in sorted order, by prefix doubling over the suffixes not yet told apart."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_text[1:], sorted_text[:-1], out=new[1:])
    new[sorted_text == 0] = True
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = starts
    rank[n] = -1
    single = new & np.append(new[1:], True)
    active = order[~single]
    width = 1
    while len(active):
        own = rank[active]
        key = own * (n + 2) + rank[np.minimum(active + width, n)] + 1
        by = np.argsort(key)
        active, key, own = active[by], key[by], own[by]
        at = np.arange(len(active))
        new_group = np.append(True, own[1:] != own[:-1])
        new_key = np.append(True, key[1:] != key[:-1])
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        key_at = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[active] = own + (key_at - group_at)
        active = active[~(new_key & np.append(new_key[1:], True))]
        width *= 2
    return rank[:n]


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        """``text``: symbols below ``n_symbols``; it must start and end with the separator 0."""
        n = self.n = len(text)
        rank = suffix_ranks(text)
        previous = np.concatenate([[0], text[:-1]]).astype(np.int32)
        bwt = np.empty(n, np.int32)
        bwt[rank] = previous
        counts = np.bincount(text, minlength=n_symbols)
        self.first = np.cumsum(counts) - counts
        # a place after a separator has no symbol to step back by, so it is always sampled
        at = np.arange(n)
        kept = (at % SAMPLE_EVERY == 0) | (previous == 0)
        self.sampled = np.zeros(n, bool)
        self.sampled[rank[kept]] = True
        self.sample_at = np.cumsum(self.sampled) - 1
        places = np.empty(n, np.int32)
        places[rank] = at
        self.samples = places[self.sampled]
        del places, rank
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bwt = bwt
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = ((level >> b) & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            if b:
                level = np.concatenate([level[~bit], level[bit]])
        symbols = np.arange(n_symbols)
        self.base = self._descend(symbols, np.zeros(n_symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            r = ones[at]
            at = np.where((symbols >> b) & 1, zeros + r, at - r)
        return at

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row to which each symbol leads back from row boundary ``at``: first row + rank."""
        return self.first[symbols] + self._descend(symbols, at) - self.base[symbols]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges; phrases are right-aligned rows padded on the left, symbols over 0."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero(lengths > 0)
        width = phrases.shape[1]
        for k in range(width):
            alive = alive[(lengths[alive] > k) & (lo[alive] < hi[alive])]
            if not len(alive):
                break
            symbols = phrases[alive, width - 1 - k]
            lo[alive] = self.step(symbols, lo[alive])
            hi[alive] = self.step(symbols, hi[alive])
        hi = np.where(lengths > 0, np.maximum(lo, hi), lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by stepping back to a sampled row."""
        rows = rows.astype(np.int64)
        steps = np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            at = rows[walking]
            rows[walking] = self.step(self.bwt[at], at)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.samples[self.sample_at[rows]] + steps
