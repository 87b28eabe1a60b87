"""Column helpers for missing and infinite values: NULL is missing, NaN never stays in a panel, infinities are values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nz(x: Column) -> Column:
    """NaN becomes missing."""
    return F.when(~F.isnan(x), x)


def is_inf(x: Column) -> Column:
    return F.abs(x) == INF


def fin(x: Column) -> Column:
    """Infinite values become missing."""
    return F.when(~is_inf(x), x)


def fin0(x: Column) -> Column:
    """Infinite values become 0; missing stays missing."""
    return F.when(is_inf(x), F.lit(0.0)).otherwise(x)


def nan_to_num(x: Column, missing: float, above: float, below: float) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(missing)).when(x == INF, F.lit(above)).when(x == -INF, F.lit(below)).otherwise(x)


def ieee_div(a: Column, b: Column) -> Column:
    """Division that gives infinities and NaN instead of raising."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Values moved into [low, high]; missing stays missing."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def valid(*xs: Column) -> Column:
    """Whether all of these are there."""
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull()
    return out


def constant(value: float) -> Column:
    return F.lit(value).cast("double")


def exp_utility(x: Column) -> Column:
    return F.expm1(x)


def piecewise_score(x: Column, a: float, b: float) -> Column:
    """Slope 1 / (b - a) between a and b; beyond b one tenth of it, on a's side ten times it, measured as distances."""
    s = 1.0 / (b - a)
    inside = (x > min(a, b)) & (x < max(a, b))
    nearer_b = F.abs(x - b) < F.abs(x - a)
    return F.when(inside, s * F.abs(x - a)).when(nearer_b, 1 + 0.1 * s * F.abs(x - b)).when(x.isNotNull(), 10 * s * F.abs(x - a))
