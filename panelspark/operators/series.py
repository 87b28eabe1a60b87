"""Long trailing windows over an instrument's whole series, in time that hardly grows with the window.

A window is put together from blocks of 1, 2, 4 ... rows, as its length's binary digits say.  A block's state (a sum, an
extreme with its row, moments about its own mean) is merged from its two halves, so that only values of the window
itself ever meet: nothing is taken away from a running total, and a huge value leaves no trace once it has left the
window.  Blocks end at every row and are shared by all windows and operators over the same inputs.

Series are arrays of doubles in which NaN is missing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np

from .registry import LONG

State = tuple[np.ndarray, ...]


class Blocks:
    """States of the last 1, 2, 4 ... rows up to each row; ``empty`` is the state of no rows."""

    def __init__(self, rows: State, empty: tuple, merge: Callable[[State, State], State]):
        self.levels, self.empty, self.merge = [rows], empty, merge

    def back(self, state: State, k: int) -> State:
        """What ``state`` was k rows ago."""
        if not k:
            return state
        n = len(state[0])
        out = []
        for own, e in zip(state, self.empty):
            moved = np.empty(n, dtype=own.dtype)
            moved[:k] = e
            moved[k:] = own[: max(n - k, 0)]
            out.append(moved)
        return tuple(out)

    def last(self, d: int) -> State:
        """States of the last d rows."""
        found, behind = None, 0
        for k in range(d.bit_length()):
            if k == len(self.levels):
                half = self.levels[-1]
                self.levels.append(self.merge(self.back(half, 1 << (k - 1)), half))
            if d >> k & 1:
                block = self.back(self.levels[k], behind)
                found = block if found is None else self.merge(block, found)
                behind += 1 << k
        return found


def _with_values(x: np.ndarray, other: float) -> np.ndarray:
    """The finite values; ``other`` in place of missing and infinite ones."""
    return np.where(np.isfinite(x), x, other)


def counts(there: np.ndarray, d: int) -> np.ndarray:
    """How many of the last d rows are marked.  Whole numbers, so that taking away leaves no trace."""
    found = np.cumsum(there, dtype=float)
    found[d:] -= found[:-d].copy()
    return found


def sums(x: np.ndarray) -> Blocks:
    """(values that are there, sum of the finite ones)"""
    return Blocks(((~np.isnan(x)).astype(float), _with_values(x, 0.0)), (0.0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1]))


def products(x: np.ndarray) -> Blocks:
    return Blocks(((~np.isnan(x)).astype(float), _with_values(x, 1.0)), (0.0, 1.0), lambda a, b: (a[0] + b[0], a[1] * b[1]))


def extremes(x: np.ndarray, sign: float) -> Blocks:
    """(largest finite ``sign * x`` or -inf)"""
    return Blocks((_with_values(sign * x, -np.inf),), (-np.inf,), lambda a, b: (np.maximum(a[0], b[0]),))


def placed_extremes(x: np.ndarray, sign: float) -> Blocks:
    """(largest finite ``sign * x`` or -inf, its row; the later of equals)"""

    def merge(a: State, b: State) -> State:
        return np.maximum(a[0], b[0]), np.where(b[0] >= a[0], b[1], a[1])

    return Blocks((_with_values(sign * x, -np.inf), np.arange(len(x), dtype=float)), (-np.inf, -1.0), merge)


def moments(x: np.ndarray, y: np.ndarray) -> Blocks:
    """(pairs of finite values, means of both, centred sums xx, xy, yy); means of no values are 0"""
    finite = np.isfinite(x) & np.isfinite(y)
    zero = np.zeros(len(x))

    def merge(a: State, b: State) -> State:
        n = a[0] + b[0]
        share = b[0] / np.maximum(n, 1.0)
        both = a[0] * share  # 0 where a side is empty
        filled, only_b = (both > 0).astype(float), (a[0] == 0).astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            dx, dy = (b[1] - a[1]) * filled, (b[2] - a[2]) * filled
            return (
                n, a[1] + dx * share + b[1] * only_b, a[2] + dy * share + b[2] * only_b,
                a[3] + b[3] + dx * dx * both, a[4] + b[4] + dx * dy * both, a[5] + b[5] + dy * dy * both,
            )

    return Blocks((finite.astype(float), np.where(finite, x, 0.0), np.where(finite, y, 0.0), zero, zero, zero), (0.0,) * 6, merge)


def _pairs(x: np.ndarray, y: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs that are there in the window, pairs with an infinity)"""
    there = ~(np.isnan(x) | np.isnan(y))
    return counts(there, d), counts(there & ~(np.isfinite(x) & np.isfinite(y)), d)


def held(cache: dict, make: Callable[..., Blocks], *args) -> Blocks:
    """The blocks of these inputs, made once for all windows of a wave."""
    key = (make, *(id(a) if isinstance(a, np.ndarray) else a for a in args))
    if key not in cache:
        cache[key] = make(*args)
    return cache[key]


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Missing where the divisor is not above 0."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)


def long_sum(cache: dict, x: np.ndarray, d: int) -> np.ndarray:
    n, total = held(cache, sums, x).last(d)
    return np.where(n > 0, total, np.nan)


def long_mean(cache: dict, x: np.ndarray, d: int) -> np.ndarray:
    n, total = held(cache, sums, x).last(d)
    return _divided(total, n)


def long_prod(cache: dict, x: np.ndarray, d: int) -> np.ndarray:
    n, total = held(cache, products, x).last(d)
    return np.where(n > 0, total, np.nan)


def long_extreme(sign: float) -> Callable:
    def run(cache: dict, x: np.ndarray, d: int) -> np.ndarray:
        (best,) = held(cache, extremes, x, sign).last(d)
        return np.where(np.isinf(best), np.nan, sign * best)

    return run


def long_age(sign: float) -> Callable:
    """Rows since the extreme of the last d + 1 rows; 0 where only infinities are there."""

    def run(cache: dict, x: np.ndarray, d: int) -> np.ndarray:
        best, at = held(cache, placed_extremes, x, sign).last(d + 1)
        return np.where(np.isfinite(best), np.arange(len(x)) - at, np.where(counts(~np.isnan(x), d + 1) > 0, 0.0, np.nan))

    return run


def long_stddev(cache: dict, x: np.ndarray, d: int) -> np.ndarray:
    """Infinities count as values without a deviation."""
    finite, mean, _, squares, _, _ = held(cache, moments, x, x).last(d)
    n, _ = _pairs(x, x, d)
    middle = finite * mean / np.maximum(n, 1.0)
    squares = squares + finite * (mean - middle) ** 2
    return np.sqrt(_divided(squares, n - 1))


def long_cov(cache: dict, x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
    (_, _, _, _, xy, _), (n, bad) = held(cache, moments, x, y).last(d), _pairs(x, y, d)
    return np.where(bad > 0, np.nan, _divided(xy, n - 1))


def long_corr(cache: dict, x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
    (n, _, _, xx, xy, yy), (_, bad) = held(cache, moments, x, y).last(d), _pairs(x, y, d)
    return np.where((bad > 0) | (n <= 1), np.nan, _divided(xy, np.sqrt(xx) * np.sqrt(yy)))


def long_rank(cache: dict, x: np.ndarray, d: int) -> np.ndarray:
    """ts_rank: short windows row by row of the window, long ones kept sorted."""
    if d <= LONG:
        there = ~np.isnan(x)
        below, n = np.zeros(len(x)), np.zeros(len(x))
        for k in range(min(d, len(x))):
            below[k:] += x[: len(x) - k] <= x[k:]
            n[k:] += there[: len(x) - k]
        return np.where(there, below / np.maximum(n, 1.0), np.nan)
    out, window, values = np.full(len(x), np.nan), [], x.tolist()
    for i, v in enumerate(values):
        if i >= d and (old := values[i - d]) == old:
            del window[bisect_left(window, old)]
        if v == v:
            insort(window, v)
            out[i] = bisect_right(window, v) / len(window)
    return out
