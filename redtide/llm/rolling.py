"""Hashes of all windows of a sequence, window minima and their places, vectorised."""

from __future__ import annotations

import numpy as np

from redtide.llm.sketch import mixed

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n, kept for the process."""
    up, down = _POWERS.get(base, (np.empty(0, np.uint64),) * 2)
    if len(up) < n:
        size = max(n, 2 * len(up), 1 << 12)
        inverse = np.uint64(pow(base, -1, 1 << 64))
        ones = np.full(size, base, np.uint64)
        ones[0] = 1
        up = np.cumprod(ones, dtype=np.uint64)
        ones = np.full(size, inverse, np.uint64)
        ones[0] = 1
        down = np.cumprod(ones, dtype=np.uint64)
        _POWERS[base] = up, down
    return up[:n], down[:n]


def window_hashes(values: np.ndarray, window: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each run of `window` values; equal runs have equal hashes."""
    n = len(values)
    if n < window:
        return np.empty(0, np.uint64)
    up, down = _powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mixed((sums[window:] - sums[:-window]) * down[: n - window + 1])


def _sliding(values: np.ndarray, window: int, pick) -> np.ndarray:
    size, now = 1, values
    while 2 * size <= window:
        now, size = pick(now[:-size], now[size:]), 2 * size
    return now if size == window else pick(now[: len(now) - (window - size)], now[window - size :])


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    return _sliding(values, window, np.minimum)


def anchors(grams: np.ndarray, minima: np.ndarray, window: int) -> np.ndarray:
    """Places whose value is the least of some window of `window` values."""
    if not len(minima):
        return np.empty(0, np.int64)
    edge = np.zeros(window - 1, np.uint64)
    highest = _sliding(np.concatenate([edge, minima, edge]), window, np.maximum)
    return np.flatnonzero(highest == grams)


def anchor_of_windows(grams: np.ndarray, minima: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each window, which of `places` is the first in it that has the window's least value."""
    at = np.searchsorted(places, np.arange(len(minima)))
    least = grams[places]
    wrong = np.flatnonzero(least[at] != minima)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[least[at[wrong]] != minima[wrong]]
    return at


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))
