"""The operators over arrays, for state that streams keep: NaN is missing, rows are in order of dates.

Trailing operators get the rows before the new ones too; what they give for those is not used.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..operators import operator


def _divide(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.nan_to_num(x / y, nan=0.0, posinf=1e9, neginf=-1e9)


def _delay(x: np.ndarray, d: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if d >= 0:
        out[d:] = x[: max(len(x) - d, 0)]
    return out


def _observed_return(x: np.ndarray) -> np.ndarray:
    at = np.where(np.isnan(x), -1, np.arange(len(x)))
    before = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]])
    return np.where(before >= 0, x / x[before] - 1, np.nan)


def average_rank(x: np.ndarray) -> np.ndarray:
    """Average-tie rank among what is there, scaled to [0, 1]."""
    held = np.sort(x[~np.isnan(x)])
    low, high = np.searchsorted(held, x, "left"), np.searchsorted(held, x, "right")
    return np.where(np.isnan(x), np.nan, ((low + 1 + high) / 2 - 1) / max(len(held) - 1, 1))


def _zscore(x: np.ndarray) -> np.ndarray:
    """Infinities count as values without a deviation."""
    finite, n = x[np.isfinite(x)], max(int((~np.isnan(x)).sum()), 1)
    mean = finite.sum() / n
    return (x - mean) / (np.sqrt(((finite - mean) ** 2).sum() / n) + 1e-10)


ARRAYS: dict[str, Callable] = {
    "add": np.add, "subtract": np.subtract, "multiply": np.multiply, "divide": _divide, "flip": np.negative, "sign": np.sign,
    "pow": lambda x, p: np.where(np.isnan(x), np.nan, np.power(x, np.full(len(x), p))), "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "delay": _delay, "delta": lambda x, d: x - _delay(x, d), "ts_diff": lambda x, d: x - _delay(x, d),
    "ts_return": lambda x, d: (x - _delay(x, d)) / _delay(x, d), "observed_return": _observed_return,
    "rank": average_rank, "cs_rank": average_rank, "cs_zscore": _zscore, "count_valid": lambda x: np.full(len(x), float((~np.isnan(x)).sum())),
    "rank_add": lambda x, y: average_rank(x) + average_rank(y), "rank_sub": lambda x, y: average_rank(x) - average_rank(y),
    "rank_mul": lambda x, y: average_rank(x) * average_rank(y), "rank_div": lambda x, y: average_rank(x) / average_rank(y),
}
#: Windows below these lengths give missing values (None: they count as one row).
LEAST = {"ts_mean": None, "ts_nanmean": 1, "ts_sum": 1, "ts_prod": 1, "ts_max": 1, "ts_min": 1, "ts_argmax": 0, "ts_argmin": 0, "ts_stddev": 2, "ts_rank": 1, "ts_cov": 2, "ts_corr": 2}
#: Of these a window of one row is the input itself.
SELF = {"ts_nanmean", "ts_sum", "ts_prod", "ts_max", "ts_min"}


def applied(name: str, args: list) -> np.ndarray:
    """One operator over arrays and literals."""
    with np.errstate(all="ignore"):
        if name in ARRAYS:
            return ARRAYS[name](*args)
        series, least, d = operator(name).series, LEAST.get(name, 1), args[-1]
        if series is None:
            raise KeyError(f"{name} has no form over arrays, so a stream cannot keep it up to date")
        if least is not None and d < least:
            return np.full(len(args[0]), np.nan)
        if name == "ts_rank" and d == 1:
            return np.ones(len(args[0]))
        return args[0] if d == 1 and name in SELF else series({}, *args[:-1], max(d, 1) if least != 0 else d)
