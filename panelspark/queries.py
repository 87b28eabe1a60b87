"""Registered queries over the given tables, and the DuckDB SQL that gives the same rows.

Values are rounded on both sides and never NaN or negative zero, so that sums of another order compare equal.
"""

from __future__ import annotations

import gzip
import math
from collections.abc import Callable

import numpy as np
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pool as P
from .operators import register
from .operators import results as R
from .operators.cross_section import rank_by_ranges as ranked_by_ranges
from .operators.registry import INT, PANEL, TRAIL
from .operators.time_series import trailing
from .plans import SlotWeights, data, draw, evaluate, evaluate_batch, evaluate_cells, fill, grid, op, slot, weighted_fill
from .sources import matrices as M
from .sources.panel import adv, day_cells, day_panel, dense, mask_universe, month_panel, reindex, wide_ordinals, with_returns
from .sources.panel import members_only as panel_members
from .sources.scratch import fresh_folder, settled
from .streaming import bars, cross_section_stream, trailing_stream
from .streaming.arrays import average_rank
from .streaming.formulas import STORE, run_waves

X, Y = op("divide", data("close"), 997.0), op("divide", data("open"), 997.0)
VOLUME = data("volume")


def _cells(t: str, universe: str) -> str:
    return f"""
cells AS (
  SELECT {t} AS t, l_suppkey AS inst, sum(l_quantity) AS volume,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         min({{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'p': l_extendedprice}}).p AS open
  FROM lineitem GROUP BY 1, 2),
panel AS (
  SELECT g.t, u.inst, volume, close, high, low, open
  FROM {universe} CROSS JOIN (SELECT s_suppkey AS inst FROM supplier) u LEFT JOIN cells c ON c.t = g.t AND c.inst = u.inst)"""


MONTH_SQL = "WITH " + _cells("CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT)", "(SELECT DISTINCT t FROM cells) g") + """,
f AS (SELECT *, close / 997.0 AS x, open / 997.0 AS y FROM panel),
r AS (SELECT *, lead(returns) OVER (PARTITION BY inst ORDER BY t) AS returns_d1 FROM (
  SELECT *, (close - lag(close) OVER (PARTITION BY inst ORDER BY t)) / lag(close) OVER (PARTITION BY inst ORDER BY t) AS returns FROM f))
"""
DAY_SQL = "WITH days AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS t FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem))," + _cells(
    "(SELECT t FROM days WHERE d = CAST(l_shipdate AS DATE))", "(SELECT t FROM days) g"
)
DAY_SQL = DAY_SQL.replace("SELECT (SELECT t FROM days WHERE d = CAST(l_shipdate AS DATE)) AS t", "SELECT days.t AS t").replace("FROM lineitem GROUP BY 1, 2", "FROM lineitem JOIN days ON d = CAST(l_shipdate AS DATE) GROUP BY 1, 2")


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def _sql_tidy(x: str, digits: int = 6) -> str:
    return f"round(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, {digits}) + 0.0"


def _sql_half_up(x: str, digits: int = 6) -> str:
    """``tidy``'s rule: the number as it is written, halves away from zero.  DuckDB's round multiplies first, which moves
    numbers across a half."""
    written = f"CAST(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,{digits})) AS VARCHAR) AS DOUBLE)"
    return f"CASE WHEN isnan({x}) THEN NULL WHEN abs({x}) >= 1e16 THEN {x} ELSE {written} + 0.0 END"


#: Values are multiplied by this before digits are cut, since halves of binary fractions are rounded up by one engine
#: and to even by the other.
UNTIE = math.pi / 3


def significant(x: Column) -> Column:
    """Seven significant digits (times ``UNTIE``), so that values of any size are compared alike; what sums have cancelled
    down to less than 1e-9 is 0."""
    return F.when(F.abs(x) < 1e-9, F.lit(0.0)).when(x.isNotNull(), F.format_string("%.6e", x * UNTIE).cast("double"))


_POWERS = 22  #: powers of ten up to this one are doubles without an error


def with_significant(frame: DataFrame, name: str = "value") -> DataFrame:
    """``frame`` with ``significant`` of the double ``name`` in its place, for as many rows as a panel has.

    Seven digits are had as a whole number of a power of ten: both are exact, so that one multiplication or division gives
    the double that the text stands for.  What lies near a half, or beyond these powers, is written out as text.  Steps are
    columns of their own, since Spark would work out a step again in every branch that uses it."""
    x, y, size, exponent, power, scaled, whole = (F.col(c) for c in (name, "__y", "__size", "__exponent", "__power", "__scaled", "__whole"))
    tens = F.array(*(F.lit(float(f"1e{k}")) for k in range(_POWERS + 1)))
    steps = frame.withColumn("__y", x * UNTIE).withColumn("__size", F.abs(y))
    steps = steps.withColumn("__exponent", F.when((size >= 1e-9) & (size < 1e28), F.floor(F.log10(size)).cast("int") - 6))
    steps = steps.withColumn("__power", F.get(tens, F.abs(exponent)))
    steps = steps.withColumn("__scaled", F.when(exponent <= 0, size * power).otherwise(size / power)).withColumn("__whole", F.rint(scaled))
    sure = (scaled >= 1e6) & (whole < 1e7) & (F.abs(F.abs(scaled - whole) - 0.5) > 1e-4)
    back = F.when(exponent <= 0, whole / power).otherwise(whole * power)
    value = F.when(F.abs(x) < 1e-9, F.lit(0.0)).when(sure, F.when(y < 0, -back).otherwise(back)).otherwise(significant(x))
    return steps.withColumn(name, value).select(*frame.columns)


def _sql_significant(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL WHEN abs({x}) < 1e-9 THEN 0.0 ELSE CAST(printf('%.6e', {x} * CAST('{UNTIE!r}' AS DOUBLE)) AS DOUBLE) END"


def _over(d: int) -> str:
    return f"OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


TS = "OVER (PARTITION BY inst ORDER BY t)"


def _rank(x: str) -> str:
    low, n = f"rank() OVER (PARTITION BY t ORDER BY {x} NULLS LAST)", f"count({x}) OVER (PARTITION BY t)"
    high = f"count({x}) OVER (PARTITION BY t ORDER BY {x} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN {x} IS NOT NULL THEN (({low} + {high}) / 2.0 - 1) / greatest({n} - 1, 1) END"


def _arg(best: str, sign: str, d: int) -> str:
    """Rows since the extreme of the last d + 1 rows, latest of equals."""
    w = f"OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN {d} PRECEDING AND CURRENT ROW)"
    at = f"({best}(CASE WHEN x IS NOT NULL THEN {{'x': x, 't': {sign}t}} END) {w}).t"
    return f"CAST(t - ({sign}{at}) AS DOUBLE)"


_DIV = "CASE WHEN {a} IS NULL OR {b} IS NULL OR ({a} = 0 AND {b} = 0) THEN 0 WHEN {b} = 0 THEN sign({a}) * 1e9 ELSE {a} / {b} END"
_BOTH = "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {} END"
_XY = (_BOTH.format("x"), _BOTH.format("y"))

#: operator: (formula over X = close/997, Y = open/997; SQL value over x, y, volume)
FORMULAS: dict[str, tuple] = {
    "data": (VOLUME, "volume"),
    "add": (op("add", X, Y), "x + y"),
    "subtract": (op("subtract", X, Y), "x - y"),
    "multiply": (op("multiply", X, Y), "x * y"),
    "divide": (op("divide", data("close"), data("open")), _DIV.format(a="close", b="open")),
    "flip": (op("flip", X), "-x"),
    "pow": (op("pow", X, 0.5), "x ** 0.5"),
    "sign": (op("sign", op("subtract", data("close"), data("open"))), "CAST(sign(close - open) AS DOUBLE)"),
    "sigmoid": (op("sigmoid", X), "1 / (1 + exp(-x))"),
    "rank": (op("rank", data("close")), _rank("close")),
    "cs_rank": (op("cs_rank", VOLUME), _rank("volume")),
    "rank_add": (op("rank_add", data("close"), VOLUME), f"{_rank('close')} + {_rank('volume')}"),
    "rank_sub": (op("rank_sub", data("close"), VOLUME), f"{_rank('close')} - {_rank('volume')}"),
    "rank_mul": (op("rank_mul", data("close"), VOLUME), f"{_rank('close')} * {_rank('volume')}"),
    "cs_zscore": (op("cs_zscore", VOLUME), "(volume - avg(volume) OVER (PARTITION BY t)) / (stddev_pop(volume) OVER (PARTITION BY t) + 1e-10)"),
    "count_valid": (op("count_valid", VOLUME), "CAST(count(volume) OVER (PARTITION BY t) AS DOUBLE)"),
    "delay": (op("delay", X, 3), f"lag(x, 3) {TS}"),
    "delta": (op("delta", X, 3), f"x - lag(x, 3) {TS}"),
    "ts_diff": (op("ts_diff", X, 1), f"x - lag(x, 1) {TS}"),
    "ts_return": (op("ts_return", X, 2), f"(x - lag(x, 2) {TS}) / lag(x, 2) {TS}"),
    "ts_mean": (op("ts_mean", X, 10), f"avg(x) {_over(10)}"),
    "ts_nanmean": (op("ts_nanmean", X, 5), f"avg(x) {_over(5)}"),
    "ts_sum": (op("ts_sum", VOLUME, 10), f"sum(volume) {_over(10)}"),
    "ts_prod": (op("ts_prod", op("divide", data("close"), 30000.0), 4), f"product(coalesce(close / 30000.0, 0)) {_over(4)}"),
    "ts_max": (op("ts_max", X, 10), f"max(x) {_over(10)}"),
    "ts_min": (op("ts_min", X, 10), f"min(x) {_over(10)}"),
    "ts_argmax": (op("ts_argmax", VOLUME, 10), _arg("max", "", 10).replace("x", "volume").replace("mavolume", "max")),
    "ts_argmin": (op("ts_argmin", VOLUME, 10), _arg("min", "-", 10).replace("x", "volume")),
    "ts_stddev": (op("ts_stddev", X, 10), f"stddev_samp(x) {_over(10)}"),
    "ts_rank": (op("ts_rank", VOLUME, 10), f"CASE WHEN volume IS NOT NULL THEN len(list_filter(list(volume) FILTER (volume IS NOT NULL) {_over(10)}, lambda v: v <= volume)) / CAST(count(volume) {_over(10)} AS DOUBLE) END"),
    "ts_cov": (op("ts_cov", X, Y, 10), f"covar_samp({_XY[0]}, {_XY[1]}) {_over(10)}"),
    "ts_corr": (op("ts_corr", X, Y, 10), f"covar_pop({_XY[0]}, {_XY[1]}) {_over(10)} / sqrt(var_pop({_XY[0]}) {_over(10)} * var_pop({_XY[1]}) {_over(10)})"),
    "observed_return": (op("observed_return", X), f"x / last_value(x IGNORE NULLS) OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1"),
}
#: X and Y divide, and so are 0 where the price is missing; the SQL's x and y are made to agree.
_F_X = "CASE WHEN close IS NULL THEN 0 ELSE close / 997.0 END"
MONTH_SQL = MONTH_SQL.replace("close / 997.0 AS x, open / 997.0 AS y", f"{_F_X} AS x, {_F_X.replace('close', 'open')} AS y")


def panel_op(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(month_panel(spark, sf_dir), {"value": FORMULAS[name][0]}).select("t", "inst", tidy(F.col("value")).alias("value"))

    return run


def panel_op_sql(name: str) -> str:
    value, show = FORMULAS[name][1], _sql_half_up if name in ("ts_return", "observed_return") else _sql_tidy
    return f"{MONTH_SQL} SELECT t, inst, {show('v')} AS value FROM (SELECT t, inst, {value} AS v FROM r)"


RANK_DIV = op("rank_div", data("close"), VOLUME)


def op_rank_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate(month_panel(spark, sf_dir), {"value": RANK_DIV})
    v = F.col("value")
    return out.select("t", "inst", F.when(v == float("inf"), F.lit(-1.0)).otherwise(tidy(v)).alias("value"))


RANK_DIV_SQL = f"""{MONTH_SQL} SELECT t, inst, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN b = 0 THEN -1.0 ELSE round(a / b, 6) + 0.0 END AS value
FROM (SELECT t, inst, {_rank('close')} AS a, {_rank('volume')} AS b FROM r)"""

#: The same operators over the daily panel, whose missing cells stay missing.
_C, _Y = data("close"), op("multiply", data("close"), 1 / 997)
GAPPY: dict[str, tuple] = {
    "rank": (op("rank", VOLUME), _rank("volume")),
    "cs_rank": (op("cs_rank", _C), _rank("close")),
    "rank_add": (op("rank_add", _C, VOLUME), FORMULAS["rank_add"][1]),
    "rank_sub": (op("rank_sub", _C, VOLUME), FORMULAS["rank_sub"][1]),
    "rank_mul": (op("rank_mul", _C, VOLUME), FORMULAS["rank_mul"][1]),
    "cs_zscore": (op("cs_zscore", VOLUME), FORMULAS["cs_zscore"][1]),
    "count_valid": (op("count_valid", VOLUME), FORMULAS["count_valid"][1]),
    "delay": (op("delay", VOLUME, 3), f"lag(volume, 3) {TS}"),
    "delta": (op("delta", VOLUME, 1), f"volume - lag(volume) {TS}"),
    "ts_diff": (op("ts_diff", _C, 2), f"close - lag(close, 2) {TS}"),
    "ts_return": (op("ts_return", _C, 2), f"(close - lag(close, 2) {TS}) / lag(close, 2) {TS}"),
    "ts_mean": (op("ts_mean", VOLUME, 10), f"avg(volume) {_over(10)}"),
    "ts_nanmean": (op("ts_nanmean", VOLUME, 21), f"avg(volume) {_over(21)}"),
    "ts_sum": (op("ts_sum", VOLUME, 5), f"sum(volume) {_over(5)}"),
    "ts_mean_long": (op("ts_mean", VOLUME, 252), f"avg(volume) {_over(252)}"),
    "ts_sum_long": (op("ts_sum", VOLUME, 100), f"sum(volume) {_over(100)}"),
    "ts_prod": (op("ts_prod", op("multiply", VOLUME, 0.03125), 4), f"product(volume * 0.03125) {_over(4)}"),
    "ts_max": (op("ts_max", _Y, 10), f"max(y) {_over(10)}"),
    "ts_min": (op("ts_min", _Y, 10), f"min(y) {_over(10)}"),
    "ts_argmax": FORMULAS["ts_argmax"],
    "ts_argmin": FORMULAS["ts_argmin"],
    "ts_stddev": (op("ts_stddev", VOLUME, 20), f"stddev_samp(volume) {_over(20)}"),
    "ts_rank": FORMULAS["ts_rank"],
    "ts_rank_long": (op("ts_rank", VOLUME, 60), FORMULAS["ts_rank"][1].replace(_over(10), _over(60))),
    "ts_cov": (op("ts_cov", VOLUME, _Y, 10), FORMULAS["ts_cov"][1]),
    "ts_corr": (op("ts_corr", VOLUME, _Y, 10), f"CASE WHEN var_pop({_XY[0]}) {_over(10)} > 0 AND var_pop({_XY[1]}) {_over(10)} > 0 THEN {FORMULAS['ts_corr'][1]} END"),
    "observed_return": (op("observed_return", _C), "close / last_value(close IGNORE NULLS) OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1"),
}
#: Long windows, with values of all sizes compared alike; ``spike`` is the volume with 1e17 more where it is 30.
_SPIKE = op("add", VOLUME, op("multiply", op("subtract", 1.0, op("pow", op("sign", op("subtract", VOLUME, 30.0)), 2.0)), 1e17))
_SPIKE_SQL = "(volume + CASE WHEN volume = 30 THEN 1e17 ELSE 0 END)"
_VAR = [f"var_pop({v}) {_over(100)}" for v in _XY]
GAPPY |= {
    "ts_sum_spike": (op("ts_sum", _SPIKE, 40), f"sum({_SPIKE_SQL}) {_over(40)}"),
    "ts_mean_spike": (op("ts_mean", _SPIKE, 252), f"avg({_SPIKE_SQL}) {_over(252)}"),
    "ts_nanmean_long": (op("ts_nanmean", _C, 100), f"avg(close) {_over(100)}"),
    "ts_prod_long": (op("ts_prod", op("multiply", VOLUME, 0.03125), 40), f"product(volume * 0.03125) {_over(40)}"),
    "ts_max_long": (op("ts_max", _C, 252), f"max(close) {_over(252)}"),
    "ts_min_long": (op("ts_min", _C, 252), f"min(close) {_over(252)}"),
    "ts_argmax_long": (op("ts_argmax", VOLUME, 252), FORMULAS["ts_argmax"][1].replace("10 PRECEDING", "252 PRECEDING")),
    "ts_argmin_long": (op("ts_argmin", VOLUME, 252), FORMULAS["ts_argmin"][1].replace("10 PRECEDING", "252 PRECEDING")),
    "ts_stddev_long": (op("ts_stddev", _C, 100), f"stddev_samp(close) {_over(100)}"),
    "ts_cov_long": (op("ts_cov", VOLUME, _C, 100), f"covar_samp({_XY[0]}, {_XY[1].replace('THEN y', 'THEN close')}) {_over(100)}"),
    "ts_corr_long": (op("ts_corr", VOLUME, _Y, 100), f"CASE WHEN {_VAR[0]} > 0 AND {_VAR[1]} > 0 THEN {FORMULAS['ts_corr'][1].replace(_over(10), _over(100))} END"),
}
#: Of the daily panel x and y are volume and close / 997, missing where these are.
_DAY_XY = f"(SELECT *, volume AS x, close * CAST('{1 / 997!r}' AS DOUBLE) AS y FROM panel)"

#: A field that is infinite where the volume is 30, and what operators make of it: infinities count as 0 in sums and are
#: left out of extremes, and rank last.
INF = op("pow", op("subtract", VOLUME, 30.0), -1.0)
_INF_SQL = "(SELECT *, CASE WHEN volume = 30 THEN CAST('infinity' AS DOUBLE) ELSE 1 / (volume - 30) END AS z FROM panel)"
_FIN0, _FIN = "CASE WHEN isinf(z) THEN 0 ELSE z END", "CASE WHEN NOT isinf(z) THEN z END"
_N, _NF = f"count(z) {_over(10)}", f"count({_FIN}) {_over(10)}"


def _squares_sql(w: str) -> str:
    """Squared deviations of the finite values from the mean in which infinities count as 0."""
    mean = f"sum({_FIN0}) {w} / nullif(count(z) {w}, 0)"
    return f"coalesce(count({_FIN}) {w} * (var_pop({_FIN}) {w} + (avg({_FIN}) {w} - {mean}) ** 2), 0)"


_BY_DATE = "OVER (PARTITION BY t)"
_ZSCORE = f"(z - sum({_FIN0}) {_BY_DATE} / count(z) {_BY_DATE}) / (sqrt({_squares_sql(_BY_DATE)} / count(z) {_BY_DATE}) + 1e-10)"
_BAD = f"coalesce(max(CASE WHEN z IS NOT NULL AND close IS NOT NULL THEN CAST(isinf(z) AS INT) END) {_over(10)}, 0) = 0"
_ZC = ["CASE WHEN NOT isinf(z) AND close IS NOT NULL THEN z END", "CASE WHEN NOT isinf(z) THEN close END"]
_BACK = "OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"
_AGE = f"coalesce(t - {{sign}}({{best}}(CASE WHEN NOT isinf(z) THEN {{{{'z': z, 't': {{sign}}t}}}} END) {_BACK}).t, CASE WHEN count(z) {_BACK} > 0 THEN 0 END)"
INFINITE: dict[str, tuple] = {
    "ts_stddev": (op("ts_stddev", INF, 10), f"CASE WHEN {_N} > 1 THEN sqrt({_squares_sql(_over(10))} / ({_N} - 1)) END"),
    "cs_zscore": (op("divide", op("cs_zscore", INF), 1.0), f"CASE WHEN z IS NULL THEN 0 WHEN isinf(z) THEN sign(z) * 1e9 ELSE {_ZSCORE} END"),
    "ts_argmax": (op("ts_argmax", INF, 10), f"CAST({_AGE.format(best='max', sign='')} AS DOUBLE)"),
    "ts_argmin": (op("ts_argmin", INF, 10), f"CAST({_AGE.format(best='min', sign='-')} AS DOUBLE)"),
    "ts_cov": (op("ts_cov", INF, _C, 10), f"CASE WHEN {_BAD} THEN covar_samp({_ZC[0]}, {_ZC[1]}) {_over(10)} END"),
    "ts_corr": (op("ts_corr", INF, _C, 10), f"CASE WHEN {_BAD} AND var_pop({_ZC[0]}) {_over(10)} > 0 AND var_pop({_ZC[1]}) {_over(10)} > 0 THEN corr({_ZC[0]}, {_ZC[1]}) {_over(10)} END"),
    "ts_mean": (op("ts_mean", INF, 10), f"sum({_FIN0}) {_over(10)} / count(z) {_over(10)}"),
    "ts_sum": (op("ts_sum", INF, 40), f"sum({_FIN0}) {_over(40)}"),
    "ts_prod": (op("ts_prod", INF, 3), f"product(CASE WHEN isinf(z) THEN 1 ELSE z END) {_over(3)}"),
    "ts_max": (op("ts_max", INF, 10), f"max({_FIN}) {_over(10)}"),
    "ts_min": (op("ts_min", INF, 10), f"min({_FIN}) {_over(10)}"),
    "rank": (op("rank", INF), _rank("z")),
    "divide": (op("divide", 1.0, op("flip", INF)), "CASE WHEN z IS NULL THEN 0 ELSE -(1 / z) END"),
    "multiply": (op("sigmoid", op("multiply", INF, -1.0)), "CASE WHEN isinf(z) THEN 0 ELSE 1 / (1 + exp(z)) END"),
}


def infinite_op(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluate_cells(*day_cells(spark, sf_dir), {"value": INFINITE[name][0]})
        if name == "ts_sum":  # sums of both signs come near 0, where only decimals can be compared
            return out.withColumn("value", tidy(F.col("value")))
        return with_significant(out)

    return run


def infinite_op_sql(name: str) -> str:
    show = _sql_tidy if name == "ts_sum" else _sql_significant
    return f"{DAY_SQL} SELECT t, inst, {show('v')} AS value FROM (SELECT t, inst, CAST({INFINITE[name][1]} AS DOUBLE) AS v FROM {_INF_SQL})"


#: Operators across a date that leave missing cells out and missing: they need the cells that are there only.
SPARSE = {"rank", "cs_rank", "rank_add", "rank_sub", "rank_mul", "cs_zscore"}


def gappy_op(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells, universe, n = day_cells(spark, sf_dir)
        if name in SPARSE:
            return dense(with_significant(evaluate(panel_members(cells, universe), {"value": GAPPY[name][0]})), universe, n)
        return with_significant(evaluate_cells(cells, universe, n, {"value": GAPPY[name][0]}))

    return run


def gappy_op_sql(name: str) -> str:
    return f"{DAY_SQL} SELECT t, inst, {_sql_significant('v')} AS value FROM (SELECT t, inst, CAST({GAPPY[name][1]} AS DOUBLE) AS v FROM {_DAY_XY})"


def rank_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rank of volume with every date's values dealt to eight ranges."""
    out = ranked_by_ranges(day_panel(spark, sf_dir).select("t", "inst", "volume"), "volume", "value", ranges=8)
    return with_significant(out.select("t", "inst", "value"))


SPIKE = op("divide", VOLUME, op("ts_mean", VOLUME, 10))
BENCH_1 = op("add", op("ts_rank", data("close"), 10), op("rank", data("close")))
DEEP = op("ts_mean", op("rank", op("delta", VOLUME, 1)), 5)


def _formula(e, panel=month_panel) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: evaluate(panel(spark, sf_dir), {"value": e}).select("t", "inst", tidy(F.col("value")).alias("value"))


_SPIKE_VALUE = _DIV.format(a="volume", b="m")
SPIKE_SQL = f"{MONTH_SQL} SELECT t, inst, round({_SPIKE_VALUE}, 6) + 0.0 AS value FROM (SELECT *, avg(volume) {_over(10)} AS m FROM r)"
BENCH_1_SQL = f"{MONTH_SQL} SELECT t, inst, round(a + b, 6) + 0.0 AS value FROM (SELECT t, inst, {FORMULAS['ts_rank'][1].replace('volume', 'close')} AS a, {_rank('close')} AS b FROM r)"
DEEP_SQL = f"""{MONTH_SQL}, d AS (SELECT t, inst, volume - lag(volume) {TS} AS v FROM r), k AS (SELECT t, inst, {_rank('v')} AS q FROM d)
SELECT t, inst, round(avg(q) {_over(5)}, 6) + 0.0 AS value FROM k"""

GRID = grid(lambda d: op("ts_mean", VOLUME, d), d=[1, 2, 3, 4, 5, 21, 252])


def grid_ts_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate(month_panel(spark, sf_dir), {f"m{e.args[1]}": e for e in GRID.values()})
    return out.select("t", "inst", *(tidy(F.col(c)).alias(c) for c in out.columns[2:]))


GRID_SQL = f"{MONTH_SQL} SELECT t, inst, " + ", ".join(f"round(avg(volume) {_over(d)}, 6) + 0.0 AS m{d}" for d in (1, 2, 3, 4, 5, 21, 252)) + " FROM r"

#: The pool of the pool queries: six signals over the monthly panel.
SIGNALS = {
    "s1": (op("rank", data("close")), _rank("close")),
    "s2": (op("flip", op("rank", VOLUME)), f"-({_rank('volume')})"),
    "s3": (op("cs_zscore", VOLUME), FORMULAS["cs_zscore"][1]),
    "s4": (op("delta", X, 1), f"x - lag(x) {TS}"),
    "s5": (op("ts_mean", X, 3), f"avg(x) {_over(3)}"),
    "s6": (op("subtract", X, Y), "x - y"),
}
NAMES = {e.canonical(): k for k, (e, _) in SIGNALS.items()}
SKIP = 12


def signal_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(expr, t, ret) of the six signals, under short names."""
    panel = with_returns(month_panel(spark, sf_dir))
    found = evaluate_batch(panel, {k: e for k, (e, _) in SIGNALS.items()})
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    return settled(found.select(names[F.col("expr")].alias("expr"), "t", "ret"))  # dates x 6 rows, which most statistics read more than once


_SUMS = ", ".join(f"sum(coalesce(s{i}, 0) * coalesce(returns_d1, 0)) / count(*) AS s{i}" for i in range(1, 7))
POOL_SQL = f"""{MONTH_SQL}, sig AS (SELECT t, inst, returns_d1, {", ".join(f"{v} AS {k}" for k, (_, v) in SIGNALS.items())} FROM r),
days AS (SELECT t, {_SUMS} FROM sig GROUP BY t),
pool AS (UNPIVOT days ON s1, s2, s3, s4, s5, s6 INTO NAME expr VALUE ret),
port AS (SELECT t, avg(ret) AS port FROM pool GROUP BY t),
pairs AS (SELECT a.expr AS e, b.expr AS o, covar_pop(a.ret, b.ret) / greatest(stddev_pop(a.ret) * stddev_pop(b.ret), 1e-9) AS c
          FROM pool a JOIN pool b ON a.t = b.t GROUP BY 1, 2),
cut AS (SELECT p.*, port FROM pool p JOIN port USING (t) WHERE t >= {SKIP}),
old AS (SELECT greatest(-10, least(10, avg(port) / greatest(stddev_pop(port), 1e-6))) AS o FROM port WHERE t >= {SKIP}),
mu AS (SELECT expr, (greatest(-10, least(10, avg(port * 6 / 7.0 + ret / 7.0) / greatest(stddev_pop(port * 6 / 7.0 + ret / 7.0), 1e-6))) - 0.9 * max(o)) * 7 AS mu
       FROM cut, old GROUP BY expr)
"""


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_pool(spark, sf_dir).select("expr", "t", tidy(F.col("ret"), 7).alias("ret"))


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.portfolio(signal_pool(spark, sf_dir)).select("t", tidy(F.col("port"), 7).alias("port"))


def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.pool_stats(signal_pool(spark, sf_dir), skip_start=SKIP, written=True)
    return out.select("expr", *(tidy(F.col(c)).alias(c) for c in ("utility", "mu", "corr", "maxcorr")))


def pool_maxcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.max_correlation(signal_pool(spark, sf_dir)).select("expr", tidy(F.col("maxcorr")).alias("maxcorr"))


def pool_marginal_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = signal_pool(spark, sf_dir)
    return P.marginal_utility(pool, pool, skip_start=SKIP).select("expr", tidy(F.col("mu")).alias("mu"))


def pool_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.near_copies(signal_pool(spark, sf_dir), 0.9).select("expr_a", "expr_b", tidy(F.col("dist")).alias("dist"))


def corr_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.correlation_histogram(signal_pool(spark, sf_dir), 30)


def pool_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = signal_pool(spark, sf_dir)
    held = pool.filter("expr in ('s1', 's2', 's3')")
    return P.add_new(held, pool.unionByName(pool)).select("expr", "t", tidy(F.col("ret"), 7).alias("ret"))


def pool_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best(P.utility(signal_pool(spark, sf_dir)), "utility", 3).select("expr", tidy(F.col("utility")).alias("utility"))


def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, infinite and zero values per supplier of the field that is infinite where the volume is 30, times the volume's change."""
    cells = evaluate(day_panel(spark, sf_dir), {"v": op("multiply", INF, op("delta", VOLUME, 1))})
    return P.data_quality(cells, "inst", "v")


def slot_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template's slot filled by five operators: the mean return of each filling."""
    template = op("rank", op("add", slot(), data("close")))
    found = fill(template, [VOLUME], ["flip", "delay", "ts_mean", "ts_max", "sigmoid"], ints=[2, 5])
    out = evaluate_batch(with_returns(month_panel(spark, sf_dir)), {e.canonical(): e for e in found})
    return out.groupBy("expr").agg(tidy(F.avg("ret"), 7).alias("mean_ret"))


def _slot_sql() -> str:
    values = {'flip(data("volume"))': "-volume", 'sigmoid(data("volume"))': "1 / (1 + exp(-volume))"}
    for d in (2, 5):
        values[f'delay(data("volume"), {d})'] = f"lag(volume, {d}) {TS}"
        values[f'ts_mean(data("volume"), {d})'] = f"avg(volume) {_over(d)}"
        values[f'ts_max(data("volume"), {d})'] = f"max(volume) {_over(d)}"
    inner = ", ".join(f"{v} + close AS v{i}" for i, v in enumerate(values.values()))
    ranks = ", ".join(f"{_rank(f'v{i}')} AS k{i}" for i in range(len(values)))
    days = ", ".join(f"sum(coalesce(k{i}, 0) * coalesce(returns_d1, 0)) / count(*) AS d{i}" for i in range(len(values)))
    rows = " UNION ALL ".join(f"""SELECT 'rank(add({k}, data("close")))' AS expr, round(avg(d{i}), 7) + 0.0 AS mean_ret FROM d""" for i, k in enumerate(values))
    return f"{MONTH_SQL}, a AS (SELECT t, inst, returns_d1, {inner} FROM r), b AS (SELECT t, returns_d1, {ranks} FROM a), d AS (SELECT t, {days} FROM b GROUP BY t) {rows}"


def slot_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fillings of a slot drawn without replacement, by the mean of two sets of operator weights, into two stages of 30 % each,
    and the mean return of each; one operator has weight 0."""
    weights = SlotWeights({"ts_mean": 0.7, "ts_max": 0.6, "sigmoid": 0.0}, 0.05).mixed(SlotWeights({"ts_mean": 0.5, "delay": 0.3, "sigmoid": 0.0}, 0.05))
    template = op("rank", op("add", slot(), data("close")))
    found = {e.canonical(): (e, w) for e, w in weighted_fill(template, [VOLUME], ["flip", "delay", "ts_mean", "ts_max", "sigmoid"], weights, ints=[2, 5])}
    drawn = draw(spark, found.values(), 2, 0.3)
    chosen = [r.expr for r in drawn.select("expr").collect()]  # as many as are evaluated
    means = evaluate_batch(with_returns(month_panel(spark, sf_dir)), {k: found[k][0] for k in chosen}).groupBy("expr").agg(tidy(F.avg("ret"), 7).alias("mean_ret"))
    return means.join(F.broadcast(drawn), "expr").select("expr", "stage", tidy(F.col("weight")).alias("weight"), "mean_ret")


#: The waiting time of a row in SQL, by its key's MD5 number.
def _wait(key: str, weight: str) -> str:
    return f"-ln((CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / {weight}"


def _slot_weighted_sql() -> str:
    weights = {'flip(data("volume"))': 0.05}
    for d in (2, 5):
        weights |= {f'delay(data("volume"), {d})': 0.175, f'ts_mean(data("volume"), {d})': 0.6, f'ts_max(data("volume"), {d})': 0.325}
    rows = ", ".join(f"""('rank(add({k}, data("close")))', CAST({w} AS DOUBLE))""" for k, w in weights.items())
    return f"""WITH s AS ({_slot_sql()}), w(expr, weight) AS (VALUES {rows}),
o AS (SELECT expr, weight, row_number() OVER (ORDER BY {_wait('expr', 'weight')}, expr) - 1 AS r FROM w)
SELECT expr, CAST(r // 2 AS INT) AS stage, round(weight, 6) + 0.0 AS weight, mean_ret FROM o JOIN s USING (expr) WHERE r < 4"""


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event counts on every day x user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("t"), F.col("user_id").alias("inst"))
    return reindex(e.groupBy("t", "inst").agg(F.count("*").alias("n")), e, e)


def observed_adv20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adv(day_panel(spark, sf_dir).select("t", "inst", "volume")).select("t", "inst", tidy(F.col("adv20")).alias("adv20"))


def universe_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume where the supplier is in the universe of the date: those whose previous volume was above 30."""
    panel = month_panel(spark, sf_dir).select("t", "inst", "volume")
    member = evaluate(panel, {"p": op("delay", VOLUME, 1)}).filter("p > 30")
    return mask_universe(panel, member, ["volume"])


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("user_id", "inst")
    out = bars(ticks, every="1 hour")
    return out.select("inst", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", tidy(F.col("volume")).alias("volume"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("seq_id"), F.struct("ts", "event_id").alias("step"), F.col("event_type").alias("token"))


def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.frequent_transitions(R.transitions(_tokens(spark, sf_dir), start="start"))
    return out.select("prev", "next", "n", tidy(F.col("p")).alias("p"))


def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of conversations as token sequences of roles."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("seq_id"), F.col("turn").alias("step"), F.col("role").alias("token"))
    out = R.sequence_features(c, data_tokens=["user"], op_tokens=["assistant"], done="system")
    return out.select("seq_id", *(tidy(F.col(k)).alias(k) for k in ("length", "n_data", "n_ops", "entropy")), "done")


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of events as batches, users as episodes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").cast("string").alias("iteration"), "user_id").agg(F.sum("value").alias("reward"), F.count("*").alias("length"))
    out = R.batch_summary(e)
    return out.select("iteration", tidy(F.col("mean_reward")).alias("mean_reward"), tidy(F.col("std_reward")).alias("std_reward"), tidy(F.col("mean_length")).alias("mean_length"), "n_valid")


def quantile_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0.99 quantile of text length by hundreds of distinct characters."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.round(F.log10(F.col("n_chars") + 1.0), 1).alias("size"), F.col("n_chars").cast("double").alias("v"))
    out = R.quantile_by_bucket(d, F.col("size"), "v", 0.99)
    return out.select("bucket", tidy(F.col("q")).alias("q"))


def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five portfolios of suppliers over the monthly returns; weights are fractions by id."""
    panel = with_returns(month_panel(spark, sf_dir))
    returns = panel.filter("t > 0").select("t", "inst", (F.coalesce("returns", F.lit(0.0)) / 100).alias("ret"))
    pids = spark.range(5).select(F.col("id").alias("pid"))
    raw = panel.select("inst").distinct().join(F.broadcast(pids)).select("pid", "inst", F.pmod(F.col("inst") * (F.col("pid") + 1) + F.col("pid"), F.lit(7)).alias("k"))
    total = raw.groupBy("pid").agg(F.sum("k").alias("s"))
    weights = raw.join(total, "pid").select("pid", "inst", (F.col("k") / F.col("s")).alias("w"))
    out = R.weighted_portfolios(returns, weights)
    return out.select("pid", *(tidy(F.col(c), 9).alias(c) for c in ("arith", "geo", "std", "drag", "half_var")))


def trajectory_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change of value from event to event over users' first 20 events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    by_step, _ = R.trajectory_summary(R.trajectory_steps(e, key="user_id", values="v"), key="user_id")
    return by_step.select("step", tidy(F.col("mean_diff")).alias("mean_diff"))


def text_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huffman and gzip size of every text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", R.huffman_length("text").alias("huffman_bits"), R.gzip_length("text").alias("gzip_bytes"))


def exact_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn without replacement into three stages of exactly a fifth each."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return R.exact_stages(d, F.col("doc_id"), 3, 0.2)


def weighted_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn without replacement, with chances in proportion to their length, into three stages of exactly a tenth each."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return R.weighted_stages(d, F.col("doc_id"), F.col("n_chars"), 3, 0.1).select("doc_id", "stage")


def quantile_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0.999 quantile of line prices by return flag and status, narrowed down by histograms."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = R.quantile_by_bucket(rows, F.concat("l_returnflag", "l_linestatus"), "l_extendedprice", 0.999, enough=100)
    return out.select("bucket", significant(F.col("q")).alias("q"))


def stage_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to four disjoint stages: rows and characters of each."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy(R.stage_of(F.col("doc_id"), 4).alias("stage")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def piecewise_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted piecewise scores of the pool's statistics."""
    stats = P.pool_stats(signal_pool(spark, sf_dir), skip_start=SKIP, written=True).unpivot("expr", ["utility", "corr", "maxcorr"], "metric", "value")
    out = P.fitness(stats, {"utility": (1.0, 0.0, 0.5), "corr": (0.5, -1.0, 1.0), "absent": (2.0, 0.0, 1.0)})
    return out.select("expr", tidy(F.col("fitness")).alias("fitness"))


def potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Potential and reward as signals join one step at a time."""
    pool = signal_pool(spark, sf_dir)
    mu = P.marginal_utility(pool, pool, skip_start=SKIP)
    steps = mu.withColumn("step", F.substring("expr", 2, 9).cast("int"))
    return P.potentials(steps).select("step", tidy(F.col("potential"), 5).alias("potential"), tidy(F.col("reward"), 5).alias("reward"))


def _long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = evaluate(month_panel(spark, sf_dir), {"position": op("subtract", op("rank", VOLUME), 0.5)}, keep=("close",))
    return P.long_short_returns(position, "position", "close")


def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longs and shorts by rank of volume."""
    out = _long_short(spark, sf_dir)
    return out.select("t", *(tidy(F.col(c), 2).alias(c) for c in ("pnl", "position")), *(tidy(F.col(c)).alias(c) for c in ("turnover", "log_return")))


def long_short_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual Sharpe ratio, return and turnover of the same."""
    return P.sharpe(_long_short(spark, sf_dir)).select(*(tidy(F.col(c)).alias(c) for c in ("sharpe", "ret", "turnover")))


LONG_SHORT_SQL = f"""{MONTH_SQL}, p AS (SELECT t, inst, close AS price, coalesce({_rank('volume')} - 0.5, 0) AS p FROM r),
d AS (SELECT *, CASE WHEN p > 0 THEN p / sum(CASE WHEN p > 0 THEN p END) OVER (PARTITION BY t) WHEN p < 0 THEN p / sum(CASE WHEN p < 0 THEN -p END) OVER (PARTITION BY t) ELSE 0 END * 1e7 AS usd FROM p),
h AS (SELECT *, coalesce(round(usd / price), 0) AS shares FROM d), v AS (SELECT *, coalesce(shares * price, 0) AS v FROM h),
g AS (SELECT t, shares * lead(price) {TS} - v AS gain, abs(v - coalesce(lag(v) {TS}, 0)) AS traded, v FROM v),
x AS (SELECT t, sum(gain) AS gain, sum(traded) AS traded, sum(abs(v)) AS position FROM g GROUP BY t),
y AS (SELECT t, gain - 0.0005 * traded AS pnl, position, traded / 1e7 AS turnover, CASE WHEN position > 0 AND (gain - 0.0005 * traded) / position > -1 THEN ln(1 + (gain - 0.0005 * traded) / position) END AS log_return FROM x)"""


def trajectory_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the mean changes per step and per user of users' first 20 events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    out = R.trajectory_medians(R.trajectory_steps(e, key="user_id", values="v"), key="user_id")
    return out.select(*(tidy(F.col(c)).alias(c) for c in ("time_median", "ensemble_median")))


def text_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of every text in a Huffman code of its own characters."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", R.huffman_length("text").alias("huffman_bits"))


def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly volumes written as a matrix and read back, shape checked; inst is the column's number."""
    panel = settled(month_panel(spark, sf_dir).select("t", "inst", "volume"))
    columns = settled(wide_ordinals(panel, "inst", "column"))
    path = fresh_folder(spark, "matrix")
    M.save_matrix(panel, "volume", columns, f"{path}/volume.csv.gz")
    out = M.load_matrices(spark, f"{path}/volume.csv.gz", dates=panel.select("t").distinct().count(), instruments=columns.count())
    return out.select("field", "t", "inst", tidy(F.col("value")).alias("value"))


def panel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event counts written as Parquet by year and read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("date"), F.col("user_id").alias("inst")).agg(F.count("*").alias("n"))
    path = fresh_folder(spark, "panel")
    M.save_panel(e, path)
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("cells"), F.sum("n").alias("n")).select(F.col("year").cast("long").alias("year"), "cells", "n")


def catalogue_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily supplier volumes and prices written as dated matrices, then read by a catalogue, which also names a file that is
    not there and one that was cut off, for the days of 1996 and the suppliers with even keys."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("date", F.to_date("l_shipdate"))
    cells = rows.groupBy("date", F.col("l_suppkey").alias("inst")).agg(F.sum("l_quantity").alias("volume"), F.max("l_extendedprice").alias("high"))
    cells = settled(cells)
    axis = settled(wide_ordinals(cells, "inst", "column"))
    path = fresh_folder(spark, "fields")
    for field in ("volume", "high"):
        M.save_dated_matrix(cells, field, axis, f"{path}/raw/{field}_d.csv")
    files, folder = pyarrow.fs.FileSystem.from_uri(f"{path}/raw")
    with files.open_output_stream(f"{folder}/cut_d.csv.gz", compression=None) as out:
        out.write(gzip.compress(b"date,2\n1996-01-02,1\n" * 99)[:-9])
    lines = [("remote_path, local_path",), ("x/volume_d.csv, volume",), ("x/high_d.csv, high",), ("x/gone_d.csv, gone",), ("x/cut_d.csv.gz, cut",)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{path}/catalogue")
    days, held = cells.filter("year(date) = 1996").select("date").distinct(), cells.filter("inst % 2 = 0").select(F.col("inst").cast("string").alias("inst")).distinct()
    kept, rejects = M.load_fields(spark, M.load_catalogue(spark, f"{path}/catalogue"), f"{path}/raw", days, held)
    found = kept.select("field", F.col("date").cast("string").alias("date"), F.col("inst").cast("long").alias("inst"), tidy(F.col("value")).alias("value"))
    return found.unionByName(rejects.select("field"), allowMissingColumns=True)


def members_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly cells of the suppliers of region 1."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey = 1")
    held = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").alias("inst"))
    return panel_members(month_panel(spark, sf_dir).select("t", "inst", "volume"), held)


def candles_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all users written as a CSV each, read, aligned on the union of their hours, with both axes numbered."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("user_id", "inst")
    path = fresh_folder(spark, "candles")
    name = F.coalesce(F.concat(F.lit("u"), F.col("inst")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    M.save_candles(bars(ticks).withColumn("inst", name).withColumn("source", F.lit("")), path)
    read = settled(M.load_candles(spark, path))  # several readers, and a file an instrument
    out = M.numbered_candles(read)
    return out.select("t", "column", "inst", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "close", tidy(F.col("volume")).alias("volume"))


def returns_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool written as a returns file and read back."""
    path = fresh_folder(spark, "returns")
    M.save_returns(signal_pool(spark, sf_dir), path)
    return M.load_returns(spark, path).select("expr", "t", tidy(F.col("ret"), 7).alias("ret"))


def returns_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three expressions of such a file."""
    path = fresh_folder(spark, "returns")
    M.save_returns(signal_pool(spark, sf_dir), path)
    return M.load_returns(spark, path, first=3).select("expr", "t", tidy(F.col("ret"), 7).alias("ret"))


def search_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's statistics written as a search log, with a line that failed, and read back."""
    s = P.pool_stats(signal_pool(spark, sf_dir), skip_start=SKIP, written=True)
    pair = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    line = F.concat_ws("\t", pair("marginal_utility", "mu"), pair("_utility", "utility"), pair("_marginal_utility", "mu"), pair("corr", "corr"), pair("maxcorr", "maxcorr"),
                       F.concat(F.lit("utility_traj: [0.5, "), F.col("mu").cast("string"), F.lit("]")), pair("Expr", "expr"))
    path = fresh_folder(spark, "log")
    failed = s.limit(1).select(F.lit("marginal_utility: failed to terminate").alias("value"))
    s.select(line.alias("value")).union(failed).write.option("compression", "gzip").text(path)
    out = M.load_search_log(spark, path)
    return out.select("expr", *(tidy(F.col(c)).alias(c) for c in ("marginal_utility", "own_marginal_utility", "utility", "corr", "maxcorr")), tidy(F.col("utility_traj")[1]).alias("last"))


def user_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator of the user's own, registered at run time: half the range of the last d values."""
    register("half_range", (PANEL, INT), TRAIL, lambda x, d: (F.max(x).over(trailing(d)) - F.min(x).over(trailing(d))) / 2, lambda d: d - 1)
    return evaluate(month_panel(spark, sf_dir), {"value": op("half_range", VOLUME, 6)}).select("t", "inst", tidy(F.col("value")).alias("value"))


def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental signals: the trailing mean of five monthly volumes per instrument, then its rank across each complete date,
    by two streams over files; the same as the batch's."""
    path = fresh_folder(spark, "stream")
    rows = month_panel(spark, sf_dir).select("t", "inst", F.col("volume").alias("value"))
    rows.write.parquet(f"{path}/rows")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()

    def run(name: str, stream: DataFrame) -> DataFrame:
        query = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(f"{path}/{name}")

    source = lambda name, schema: spark.readStream.schema(schema).parquet(f"{path}/{name}")
    mean = run("mean", trailing_stream(source("rows", rows.schema), lambda w: float(np.nanmean(w)) if np.isfinite(w).any() else float("nan"), lookback=4))
    ranks = run("rank", cross_section_stream(source("mean", mean.schema).withColumnRenamed("signal", "value"), average_rank, instruments=n))
    return ranks.select(F.col("t").cast("int").alias("t"), "inst", tidy(F.nanvl("signal", F.lit(None).cast("double"))).alias("value"))


#: Formulas of the stream query, with a change of view in the middle and at the end, and their SQL.
STREAMED = {
    "deep": op("ts_mean", op("rank", op("delta", VOLUME, 1)), 5),
    "spread": op("subtract", op("cs_zscore", op("ts_sum", VOLUME, 40)), op("ts_max", op("ts_return", VOLUME, 1), 3)),
    "place": op("rank_add", op("ts_rank", VOLUME, 12), VOLUME),
}
STREAMED_SQL = f"""{MONTH_SQL}, a AS (SELECT t, inst, volume, volume - lag(volume) {TS} AS d, sum(volume) {_over(40)} AS s, volume / lag(volume) {TS} - 1 AS g, {FORMULAS['ts_rank'][1].replace(_over(10), _over(12))} AS q FROM r),
b AS (SELECT t, inst, {_rank('d')} AS k, (s - avg(s) {_BY_DATE}) / (stddev_pop(s) {_BY_DATE} + 1e-10) AS z, max(g) {_over(3)} AS m, {_rank('q')} + {_rank('volume')} AS place FROM a)
SELECT t, inst, round(avg(k) {_over(5)}, 6) + 0.0 AS deep, round(z - m, 6) + 0.0 AS spread, round(place, 6) + 0.0 AS place FROM b"""


def stream_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas kept up to date over a stream of monthly volumes that comes in three parts; the same as the batch's."""
    path, rows = fresh_folder(spark, "formulas"), settled(month_panel(spark, sf_dir).select("t", "inst", "volume"))
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    first, last = rows.agg(F.min("t"), F.max("t")).first()
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        for k in range(3):
            part = F.floor((F.col("t") - first) * 3 / (last - first + 1)) == k
            rows.filter(part).write.mode("append").parquet(f"{path}/rows")
            out = run_waves(spark, spark.readStream.schema(rows.schema).parquet(f"{path}/rows"), STREAMED, f"{path}/out", instruments=n)
    finally:
        spark.conf.set(STORE[0], before)
    return out.select(F.col("t").cast("int").alias("t"), "inst", *(tidy(F.col(c)).alias(c) for c in STREAMED))


#: Hours that ticks may lag behind the latest one, in the query of late ticks.
LAG_HOURS = 6
_ARRIVES = "greatest(least(CAST((us - a) * 4 // (b - a + 1) AS BIGINT) + CASE WHEN event_id % 20 = 7 THEN 1 WHEN event_id % 50 = 3 THEN 3 ELSE 0 END, 3), 0)"
STREAM_BARS_SQL = f"""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), s AS (SELECT min(us) AS a, max(us) AS b FROM e),
x AS (SELECT user_id, ts, us, value, {_ARRIVES} AS part FROM e, s),
w AS (SELECT part, max(max(us)) OVER (ORDER BY part) // 1000 * 1000 - {LAG_HOURS} * 3600000000 AS mark FROM x GROUP BY part),
y AS (SELECT x.*, coalesce((SELECT max(mark) FROM w WHERE w.part < x.part), 0) AS mark FROM x)
SELECT user_id AS inst, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
round(sum(value), 6) + 0.0 AS volume FROM y WHERE epoch_us(date_trunc('hour', ts)) + 3600000000 > mark AND epoch_us(date_trunc('hour', ts)) + 3600000000 <= (SELECT max(mark) FROM w) GROUP BY 1, 2"""


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars over a stream of ticks in four parts, one in twenty of which comes a part later and one in fifty in the
    last: ticks within the lag are merged, later ones go, and a bar comes out once, when its hour is over for good."""
    path = fresh_folder(spark, "ticks")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    late = F.when(F.col("event_id") % 20 == 7, 1).when(F.col("event_id") % 50 == 3, 3).otherwise(0)
    part = F.least(F.floor((F.col("us") - first) * 4 / (last - first + 1)) + late, F.lit(3))
    ticks = settled(rows.select(F.col("user_id").alias("inst"), F.col("ts").cast("timestamp").alias("ts"), "value", part.alias("part")))
    schema = ticks.drop("part").schema
    for k in range(4):
        ticks.filter(F.col("part") == k).drop("part").write.mode("append").parquet(f"{path}/rows")
        made = bars(spark.readStream.schema(schema).parquet(f"{path}/rows"), every="1 hour", late=f"{LAG_HOURS} hours")
        made.writeStream.format("parquet").option("path", f"{path}/bars").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/bars")
    return out.select("inst", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", tidy(F.col("volume")).alias("volume"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"op_{k}": panel_op(k) for k in FORMULAS},
    **{f"op_{k}_day": gappy_op(k) for k in GAPPY},
    **{f"op_{k}_inf": infinite_op(k) for k in INFINITE},
    "op_rank_div": op_rank_div,
    "expr_volume_spike": _formula(SPIKE),
    "expr_bench_1": _formula(BENCH_1),
    "expr_mixed_deep": _formula(DEEP),
    **{f.__name__: f for f in (
        grid_ts_mean, backtest, portfolio, pool_stats, pool_maxcorr, pool_marginal_utility, pool_near_copies, corr_hist, pool_dedup, pool_top, data_quality,
        slot_batch, slot_weighted, observed_adv20, universe_mask, candles, transition_matrix, sequence_features, batch_summary, quantile_by_bucket,
        portfolio_weights, trajectory_steps, text_complexity, stage_sampling, exact_stages, weighted_stages, quantile_prices, piecewise_fitness, potentials, long_short,
        long_short_sharpe, trajectory_medians, text_huffman, matrix_round_trip, panel_round_trip, catalogue_round_trip, members_only, candles_round_trip,
        returns_round_trip, returns_first, search_log_round_trip, user_operator, rank_by_ranges, stream_signals, stream_formulas, stream_bars,
    )},
    "reindex": reindexed,
}

_SCORE = "CASE WHEN {x} > {a} AND {x} < {b} THEN {s} * abs({x} - {a}) WHEN abs({x} - {b}) < abs({x} - {a}) THEN 1 + 0.1 * {s} * abs({x} - {b}) ELSE 10 * {s} * abs({x} - {a}) END"
ORACLES: dict[str, str] = {
    **{f"op_{k}": panel_op_sql(k) for k in FORMULAS},
    **{f"op_{k}_day": gappy_op_sql(k) for k in GAPPY},
    **{f"op_{k}_inf": infinite_op_sql(k) for k in INFINITE},
    "op_rank_div": RANK_DIV_SQL,
    "expr_volume_spike": SPIKE_SQL,
    "expr_bench_1": BENCH_1_SQL,
    "expr_mixed_deep": DEEP_SQL,
    "grid_ts_mean": GRID_SQL,
    "backtest": f"{POOL_SQL} SELECT expr, t, round(ret, 7) + 0.0 AS ret FROM pool",
    "portfolio": f"{POOL_SQL} SELECT t, round(port, 7) + 0.0 AS port FROM port",
    "pool_stats": f"""{POOL_SQL} SELECT expr, round(u, 6) + 0.0 AS utility, round(mu, 6) + 0.0 AS mu, round(c, 6) + 0.0 AS corr, round(m, 6) + 0.0 AS maxcorr
FROM (SELECT expr, avg(ret) / greatest(stddev_pop(ret), 1e-9) AS u FROM pool GROUP BY expr) JOIN mu USING (expr)
JOIN (SELECT expr, covar_pop(ret, port) / greatest(stddev_pop(ret) * stddev_pop(port), 1e-9) AS c FROM pool JOIN port USING (t) GROUP BY expr) USING (expr)
JOIN (SELECT e AS expr, max(c) AS m FROM pairs WHERE e <> o GROUP BY e) USING (expr)""",
    "pool_maxcorr": f"{POOL_SQL} SELECT e AS expr, round(max(c), 6) + 0.0 AS maxcorr FROM pairs WHERE e <> o GROUP BY e",
    "pool_marginal_utility": f"{POOL_SQL} SELECT expr, round(mu, 6) + 0.0 AS mu FROM mu",
    "pool_near_copies": f"{POOL_SQL} SELECT e AS expr_a, o AS expr_b, round(1 - abs(c), 6) + 0.0 AS dist FROM pairs WHERE e < o AND 1 - abs(c) <= 0.9",
    "corr_hist": f"""{POOL_SQL}, u AS (SELECT round(c, 9) AS c FROM pairs WHERE e <= o), b AS (SELECT min(c) AS lo, max(c) AS hi FROM u)
SELECT CAST(least(floor((c - lo) / (hi - lo) * 30), 29) AS INT) AS bin, count(*) AS n FROM u, b GROUP BY 1""",
    "pool_dedup": f"{POOL_SQL} SELECT expr, t, round(ret, 7) + 0.0 AS ret FROM pool",
    "pool_top": f"{POOL_SQL} SELECT expr, round(avg(ret) / greatest(stddev_pop(ret), 1e-9), 6) + 0.0 AS utility FROM pool GROUP BY expr ORDER BY avg(ret) / greatest(stddev_pop(ret), 1e-9) DESC LIMIT 3",
    "data_quality": f"""{DAY_SQL}, d AS (SELECT inst, z * (volume - lag(volume) {TS}) AS v FROM {_INF_SQL})
SELECT inst, count(*) AS total, count(*) FILTER (v IS NULL OR isnan(v)) AS missing, count(*) FILTER (isinf(v)) AS infinite, count(*) FILTER (v = 0) AS zero FROM d GROUP BY inst""",
    "slot_batch": _slot_sql(),
    "slot_weighted": _slot_weighted_sql(),
    "observed_adv20": f"""{DAY_SQL} SELECT t, inst, CASE WHEN count(volume) OVER w = 20 THEN round(avg(volume) OVER w, 6) + 0.0 END AS adv20 FROM panel
WINDOW w AS (PARTITION BY inst, volume IS NULL ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "universe_mask": f"{MONTH_SQL} SELECT t, inst, CASE WHEN p > 30 THEN volume END AS volume FROM (SELECT t, inst, volume, lag(volume) {TS} AS p FROM r)",
    "candles": """SELECT user_id AS inst, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
arg_max(value, ts) AS close, round(sum(value), 6) + 0.0 AS volume FROM events GROUP BY 1, 2""",
    "transition_matrix": """WITH s AS (SELECT coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'start') AS prev, event_type AS next FROM events),
c AS (SELECT prev, next, count(*) AS n FROM s GROUP BY 1, 2), q AS (SELECT *, n / sum(n) OVER (PARTITION BY prev) AS p FROM c)
SELECT prev, next, n, round(p, 6) + 0.0 AS p FROM q WHERE p > 0.005""",
    "sequence_features": """WITH c AS (SELECT conv_id AS seq_id, role AS token, count(*) AS n FROM conversations GROUP BY 1, 2),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY seq_id) AS p FROM c)
SELECT seq_id, round(sum(n) / 30.0, 6) + 0.0 AS length, round(sum(CASE WHEN token = 'user' THEN n ELSE 0 END) / 30.0, 6) + 0.0 AS n_data,
round(sum(CASE WHEN token = 'assistant' THEN n ELSE 0 END) / 30.0, 6) + 0.0 AS n_ops, round(sum(-p * ln(p)), 6) + 0.0 AS entropy, max(CAST(token = 'system' AS INT)) AS done FROM p GROUP BY 1""",
    "batch_summary": """WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS iteration, user_id, sum(value) AS reward, count(*) AS length FROM events GROUP BY 1, 2)
SELECT iteration, round(avg(reward), 6) + 0.0 AS mean_reward, round(stddev_pop(reward), 6) + 0.0 AS std_reward, round(avg(length), 6) + 0.0 AS mean_length, count(reward) AS n_valid FROM e GROUP BY 1""",
    "quantile_by_bucket": "SELECT round(log10(n_chars + 1.0), 1) AS bucket, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.99), 6) + 0.0 AS q FROM documents GROUP BY 1",
    "portfolio_weights": f"""{MONTH_SQL}, x AS (SELECT t, inst, coalesce(returns, 0.0) / 100 AS ret FROM r WHERE t > 0),
raw AS (SELECT pid, inst, (inst * (pid + 1) + pid) % 7 AS k FROM (SELECT DISTINCT inst FROM r) CROSS JOIN (SELECT unnest(range(5)) AS pid)),
w AS (SELECT pid, inst, k / sum(k) OVER (PARTITION BY pid) AS w FROM raw),
d AS (SELECT pid, t, sum(w * ret) AS v FROM x JOIN w USING (inst) GROUP BY 1, 2),
m AS (SELECT pid, avg(v) AS arith, exp(avg(ln(1 + v))) - 1 AS geo, stddev_samp(v) AS std FROM d GROUP BY pid)
SELECT CAST(pid AS BIGINT) AS pid, round(arith, 9) + 0.0 AS arith, round(geo, 9) + 0.0 AS geo, round(std, 9) + 0.0 AS std, round(geo - arith, 9) + 0.0 AS drag, round(std * std / 2, 9) + 0.0 AS half_var FROM m""",
    "trajectory_steps": """WITH e AS (SELECT user_id, value, row_number() OVER w - 1 AS step, value - lag(value) OVER w AS diff, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT CAST(step AS INT) AS step, round(avg(diff), 6) + 0.0 AS mean_diff FROM e WHERE n >= 20 AND step BETWEEN 1 AND 19 GROUP BY 1""",
    "piecewise_fitness": f"""{POOL_SQL}, u AS (SELECT expr, avg(ret) / greatest(stddev_pop(ret), 1e-9) AS u FROM pool GROUP BY expr),
k AS (SELECT expr, covar_pop(ret, port) / greatest(stddev_pop(ret) * stddev_pop(port), 1e-9) AS c FROM pool JOIN port USING (t) GROUP BY expr)
SELECT expr, round({_SCORE.format(x='u', a='0.0', b='0.5', s='2.0')} + 0.5 * {_SCORE.format(x='c', a='(-1.0)', b='1.0', s='0.5')}, 6) + 0.0 AS fitness FROM u JOIN k USING (expr)""",
    "potentials": f"""{POOL_SQL}, s AS (SELECT CAST(substr(expr, 2) AS INT) AS step, exp(mu) - 1 AS p FROM mu)
SELECT step, round(p, 5) + 0.0 AS potential, round(p - coalesce(lag(p) OVER (ORDER BY step), 0), 5) + 0.0 AS reward FROM s""",
    "reindex": """WITH e AS (SELECT CAST(ts AS DATE) AS t, user_id AS inst FROM events), c AS (SELECT t, inst, count(*) AS n FROM e GROUP BY 1, 2)
SELECT a.t, b.inst, n FROM (SELECT DISTINCT t FROM e) a CROSS JOIN (SELECT DISTINCT inst FROM e) b LEFT JOIN c ON c.t = a.t AND c.inst = b.inst""",
    "long_short": f"{LONG_SHORT_SQL} SELECT t, round(pnl, 2) + 0.0 AS pnl, round(position, 2) + 0.0 AS position, round(turnover, 6) + 0.0 AS turnover, round(log_return, 6) + 0.0 AS log_return FROM y",
    "long_short_sharpe": f"{LONG_SHORT_SQL} SELECT round(avg(log_return) / stddev_pop(log_return) * sqrt(252), 6) + 0.0 AS sharpe, round(sum(log_return), 6) + 0.0 AS ret, round(avg(turnover), 6) + 0.0 AS turnover FROM y",
    "trajectory_medians": """WITH e AS (SELECT user_id, row_number() OVER w - 1 AS step, value - lag(value) OVER w AS diff, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT * FROM e WHERE n >= 20 AND step BETWEEN 1 AND 19)
SELECT (SELECT round(median(m), 6) + 0.0 FROM (SELECT avg(diff) AS m FROM d GROUP BY step)) AS time_median, (SELECT round(median(m), 6) + 0.0 FROM (SELECT avg(diff) AS m FROM d GROUP BY user_id)) AS ensemble_median""",
    "text_huffman": """WITH RECURSIVE c AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY doc_id, ch),
h(doc_id, l, bits) AS (SELECT doc_id, list_sort(list(n)), CASE WHEN count(*) = 1 THEN sum(n) ELSE 0 END FROM c GROUP BY doc_id
  UNION ALL SELECT doc_id, list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM h WHERE len(l) > 1)
SELECT d.doc_id, CAST(coalesce(b, 0) AS BIGINT) AS huffman_bits FROM documents d LEFT JOIN (SELECT doc_id, max(bits) AS b FROM h GROUP BY doc_id) USING (doc_id)""",
    "stage_sampling": "SELECT CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS INT) AS stage, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "exact_stages": """WITH o AS (SELECT doc_id, count(*) OVER () // 5 AS m,
row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT), CAST(doc_id AS VARCHAR)) - 1 AS r FROM documents)
SELECT doc_id, CAST(r // m AS INT) AS stage FROM o WHERE r < 3 * m""",
    "weighted_stages": f"""WITH o AS (SELECT doc_id, count(*) OVER () // 10 AS m, row_number() OVER (ORDER BY {_wait('doc_id', 'n_chars')}, CAST(doc_id AS VARCHAR)) - 1 AS r FROM documents WHERE n_chars > 0)
SELECT doc_id, CAST(r // m AS INT) AS stage FROM o WHERE r < 3 * m""",
    "quantile_prices": f"SELECT b AS bucket, {_sql_significant('q')} AS q FROM (SELECT l_returnflag || l_linestatus AS b, quantile_cont(l_extendedprice, 0.999) AS q FROM lineitem GROUP BY 1)",
    "matrix_round_trip": f"""{MONTH_SQL} SELECT 'volume' AS field, CAST(dense_rank() OVER (ORDER BY t) - 1 AS INT) AS t, CAST(dense_rank() OVER (ORDER BY inst) - 1 AS INT) AS inst, round(volume, 6) + 0.0 AS value FROM r""",
    "panel_round_trip": "SELECT CAST(year(d) AS BIGINT) AS year, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(ts AS DATE) AS d, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "catalogue_round_trip": """WITH c AS (SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey AS inst, sum(l_quantity) AS volume, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT d FROM c WHERE year(d) = 1996) CROSS JOIN (SELECT DISTINCT inst FROM c WHERE inst % 2 = 0) LEFT JOIN c USING (d, inst))
SELECT 'volume' AS field, CAST(d AS VARCHAR) AS date, CAST(inst AS BIGINT) AS inst, round(volume, 6) + 0.0 AS value FROM g
UNION ALL SELECT 'high', CAST(d AS VARCHAR), inst, round(high, 6) + 0.0 FROM g UNION ALL SELECT 'gone', NULL, NULL, NULL UNION ALL SELECT 'cut', NULL, NULL, NULL""",
    "members_only": f"{MONTH_SQL} SELECT t, inst, volume FROM r WHERE inst IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)",
    "candles_round_trip": """WITH b AS (SELECT user_id, date_trunc('hour', ts) AS h, arg_min(value, ts) AS open, arg_max(value, ts) AS close, sum(value) AS volume FROM events GROUP BY 1, 2),
i AS (SELECT 'u' || user_id AS inst, user_id FROM (SELECT DISTINCT user_id FROM b)), g AS (SELECT * FROM (SELECT DISTINCT h FROM b) CROSS JOIN i LEFT JOIN b USING (h, user_id))
SELECT CAST(dense_rank() OVER (ORDER BY h) - 1 AS INT) AS t, CAST(dense_rank() OVER (ORDER BY inst) - 1 AS INT) AS "column", inst, strftime(h, '%Y-%m-%d %H:%M:%S') AS ts, open, close, round(volume, 6) + 0.0 AS volume FROM g""",
    "returns_round_trip": f"{POOL_SQL} SELECT expr, CAST(dense_rank() OVER (ORDER BY t) - 1 AS INT) AS t, round(ret, 7) + 0.0 AS ret FROM pool",
    "returns_first": f"{POOL_SQL} SELECT expr, CAST(dense_rank() OVER (ORDER BY t) - 1 AS INT) AS t, round(ret, 7) + 0.0 AS ret FROM pool WHERE expr IN ('s1', 's2', 's3')",
    "search_log_round_trip": f"""{POOL_SQL} SELECT expr, round(abs(mu), 6) + 0.0 AS marginal_utility, round(abs(mu), 6) + 0.0 AS own_marginal_utility, round(abs(u), 6) + 0.0 AS utility, round(abs(c), 6) + 0.0 AS corr, round(abs(m), 6) + 0.0 AS maxcorr, round(mu, 6) + 0.0 AS last
FROM (SELECT expr, avg(ret) / greatest(stddev_pop(ret), 1e-9) AS u FROM pool GROUP BY expr) JOIN mu USING (expr)
JOIN (SELECT expr, covar_pop(ret, port) / greatest(stddev_pop(ret) * stddev_pop(port), 1e-9) AS c FROM pool JOIN port USING (t) GROUP BY expr) USING (expr)
JOIN (SELECT e AS expr, max(c) AS m FROM pairs WHERE e <> o GROUP BY e) USING (expr)""",
    "user_operator": f"{MONTH_SQL} SELECT t, inst, round((max(volume) {_over(6)} - min(volume) {_over(6)}) / 2, 6) + 0.0 AS value FROM r",
    "rank_by_ranges": gappy_op_sql("rank"),
    "stream_formulas": STREAMED_SQL,
    "stream_bars": STREAM_BARS_SQL,
    "stream_signals": f"{MONTH_SQL}, m AS (SELECT t, inst, avg(volume) {_over(5)} AS v FROM r) SELECT t, inst, round({_rank('v')}, 6) + 0.0 AS value FROM m",
}
