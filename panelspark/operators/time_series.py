"""Operators over an instrument's trailing rows.  Early rows use the shorter history that there is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import fin, fin0, ieee_div, is_inf, nz, valid
from .cross_section import sum_of_squares
from .registry import INT, PANEL, TRAIL, register
from .series import long_age, long_corr, long_cov, long_extreme, long_mean, long_prod, long_rank, long_stddev, long_sum


def history():
    """The window of an instrument's rows in order."""
    return Window.partitionBy("inst").orderBy("t")


def trailing(d: int):
    return history().rowsBetween(-(d - 1), Window.currentRow)


def missing() -> Column:
    return F.lit(None).cast("double")


def delay(x: Column, d: int) -> Column:
    return missing() if d < 0 else x if d == 0 else F.lag(x, d).over(history())


def ts_mean(x: Column, d: int) -> Column:
    w = trailing(max(1, d))
    return F.try_divide(F.sum(fin0(x)).over(w), F.count(x).over(w))


def guarded(least: int, body: Callable, identity: bool = True) -> Callable:
    """Missing below ``least``; the input itself for windows of one row."""

    def build(*args):
        d = args[-1]
        if d < least:
            return missing()
        return args[0] if identity and d == 1 else body(*args)

    return build


def ts_sum(x: Column, d: int) -> Column:
    return F.sum(fin0(x)).over(trailing(d))


def ts_prod(x: Column, d: int) -> Column:
    return F.product(F.when(is_inf(x), F.lit(1.0)).otherwise(x)).over(trailing(d))


def ts_argmax(x: Column, d: int) -> Column:
    """Rows since the largest finite value of the last d + 1 rows, the most recent of equals."""
    if d < 0:
        return missing()
    w = history().rowsBetween(-d, Window.currentRow)
    at = F.max(F.when(fin(x).isNotNull(), F.struct(x.alias("x"), F.col("t").alias("t")))).over(w)["t"]
    return F.coalesce(F.col("t") - at, F.when(F.count(x).over(w) > 0, F.lit(0))).cast("double")


def ts_argmin(x: Column, d: int) -> Column:
    if d < 0:
        return missing()
    w = history().rowsBetween(-d, Window.currentRow)
    at = F.min(F.when(fin(x).isNotNull(), F.struct(x.alias("x"), (-F.col("t")).alias("n")))).over(w)["n"]
    return F.coalesce(F.col("t") + at, F.when(F.count(x).over(w) > 0, F.lit(0))).cast("double")


def ts_stddev(x: Column, d: int) -> Column:
    w = trailing(d)
    n = F.count(x).over(w)
    mean = F.try_divide(F.sum(fin0(x)).over(w), n)
    return F.when(n > 1, F.sqrt(F.try_divide(sum_of_squares(x, mean, w), n - 1)))


def ts_rank(x: Column, d: int) -> Column:
    """Share of the window's values that are at most the current one."""
    if d < 1:
        return missing()
    if d == 1:
        return F.lit(1.0)
    w = trailing(d)
    below = F.size(F.filter(F.collect_list(x).over(w), lambda v: v <= x))
    return F.when(x.isNotNull(), F.try_divide(below.cast("double"), F.count(x).over(w)))


def _pairs(x: Column, y: Column, d: int):
    w = trailing(d)
    both = valid(x, y)
    bad = F.coalesce(F.max(F.when(both, is_inf(x) | is_inf(y))).over(w), F.lit(False))
    return w, F.when(both, x), F.when(both, y), bad | (F.count(F.when(both, x)).over(w) <= 1)


def ts_cov(x: Column, y: Column, d: int) -> Column:
    w, a, b, bad = _pairs(x, y, d)
    return F.when(~bad, nz(F.covar_samp(a, b).over(w)))


def ts_corr(x: Column, y: Column, d: int) -> Column:
    w, a, b, bad = _pairs(x, y, d)
    return F.when(~bad, nz(F.try_divide(F.covar_pop(a, b).over(w), F.sqrt(F.var_pop(a).over(w)) * F.sqrt(F.var_pop(b).over(w)))))


def observed_return(x: Column) -> Column:
    """Return on the last row that has a value, however far back."""
    before = F.last(x, ignorenulls=True).over(history().rowsBetween(Window.unboundedPreceding, -1))
    return nz(ieee_div(x, before) - 1)


ONE, PAIR = (PANEL, INT), (PANEL, PANEL, INT)
back = lambda d: max(0, d)
span = lambda d: max(0, d - 1)

register("delay", ONE, TRAIL, delay, back)
register("delta", ONE, TRAIL, lambda x, d: nz(x - delay(x, d)), back)
register("ts_diff", ONE, TRAIL, lambda x, d: nz(x - delay(x, d)), back)
register("ts_return", ONE, TRAIL, lambda x, d: nz(ieee_div(x - delay(x, d), delay(x, d))), back)

register("ts_mean", ONE, TRAIL, ts_mean, span, series=long_mean)
register("ts_nanmean", ONE, TRAIL, guarded(1, ts_mean), span, series=long_mean)
register("ts_sum", ONE, TRAIL, guarded(1, ts_sum), span, series=long_sum)
register("ts_prod", ONE, TRAIL, guarded(1, ts_prod), span, series=long_prod)
register("ts_max", ONE, TRAIL, guarded(1, lambda x, d: F.max(fin(x)).over(trailing(d))), span, series=long_extreme(1.0))
register("ts_min", ONE, TRAIL, guarded(1, lambda x, d: F.min(fin(x)).over(trailing(d))), span, series=long_extreme(-1.0))
register("ts_argmax", ONE, TRAIL, ts_argmax, back, series=long_age(1.0))
register("ts_argmin", ONE, TRAIL, ts_argmin, back, series=long_age(-1.0))
register("ts_stddev", ONE, TRAIL, guarded(2, ts_stddev, False), span, series=long_stddev)
register("ts_rank", ONE, TRAIL, ts_rank, span, series=long_rank)
register("ts_cov", PAIR, TRAIL, guarded(2, ts_cov, False), span, series=long_cov)
register("ts_corr", PAIR, TRAIL, guarded(2, ts_corr, False), span, series=long_corr)
register("observed_return", (PANEL,), TRAIL, observed_return, lambda *_: None)
