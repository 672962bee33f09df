"""Vectorised 64-bit hashing of symbol streams (numpy, wrap-around arithmetic)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, U64)
_IPOW = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, 2 * len(_POW))
        a, b = np.full(size, _BASE, U64), np.full(size, _INV, U64)
        a[0] = b[0] = 1
        _POW, _IPOW = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _POW[:n], _IPOW[:n]


class Rolling:
    """Polynomial hashes of any substring of a symbol array, from prefix sums.

    ``of(start, end)`` gives one well-mixed 64-bit hash per half-open range.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        pw, self.inv = _powers(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum((symbols.astype(U64) + U64(1)) * pw[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inv[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k symbols, by start."""
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, U64)
        raw = (self.prefix[k:] - self.prefix[: n - k + 1]) * self.inv[: n - k + 1]
        return mix(raw + U64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (prefix and suffix minima of blocks of w)."""
    n = len(x)
    if n < w:
        return x[:0]
    m = -(-n // w) * w
    pad = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    prefix = np.minimum.accumulate(rows, axis=1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start, start + 1, ... of the given lengths."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1], dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (half-open) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in a half-open range."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:n]) > 0
