"""Suffix arrays of integer sequences by doubling, common prefixes of neighbours, and extensions by range minima."""

from __future__ import annotations

import numpy as np


def doubled_ranks(s: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: a number for each place, equal for two places if 2^k symbols from there are equal; the last are all different.

    The last symbol must be unique. Numbers are places in sorted order, so the last array ranks the suffixes.
    """
    n = len(s)
    _, inverse, size = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[inverse]
    out, step = [rank.astype(np.int32)], 1
    tied = np.flatnonzero(size[inverse] > 1)
    while len(tied):
        after = np.zeros(len(tied), np.int64)
        inner = tied + step < n
        after[inner] = rank[tied[inner] + step] + 1
        order = np.lexsort((after, rank[tied])) if n >= 1 << 31 else np.argsort(rank[tied] * (n + 1) + after, kind="stable")
        tied, after = tied[order], after[order]
        old = rank[tied]
        group = np.append(True, old[1:] != old[:-1])
        new = group | np.append(True, after[1:] != after[:-1])
        spot = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(group, spot, 0))
        first = np.maximum.accumulate(np.where(new, spot, 0))
        rank[tied] = old + (first - start)
        out.append(rank.astype(np.int32))
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        step *= 2
    return out


def sorted_suffixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in order, each one's rank, and how many symbols neighbours in that order have in common. The last symbol must be unique."""
    levels = doubled_ranks(s)
    rank = levels[-1].astype(np.int64)
    order = np.empty(len(s), np.int64)
    order[rank] = np.arange(len(s))
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        common += (levels[k][a + common] == levels[k][b + common]).astype(np.int64) << k
    return order, rank, common


class Extensions:
    """Longest common extensions of suffixes: suffix array, common prefixes of neighbours, and range minima over them."""

    def __init__(self, s: np.ndarray):
        _, self.rank, common = sorted_suffixes(s)
        self.least = [common.astype(np.int32)]
        while len(self.least[-1]) > 1 << len(self.least) - 1:
            last, half = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at i and j (different places) have in common."""
        lo, hi = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out
