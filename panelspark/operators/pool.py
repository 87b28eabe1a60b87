"""Return series of positions, and statistics of a pool of them: tables (expr, t, ret)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp, exp_utility, fin, is_inf, piecewise_score
from ..sources.scratch import settled

#: Fixed values of the pool statistics.
STD_FLOOR, SLICE_FLOOR, UTILITY_LIMIT, DISCOUNT, SKIP_START = 1e-9, 1e-6, 10.0, 0.90, 252
SERIES_PER_BLOCK = 128
OTHER_DATES = "the series of the pool have other dates than each other"


def _clean(x: Column) -> Column:
    return F.coalesce(fin(x), F.lit(0.0))


def backtest(positions: DataFrame, names: list[str], returns: str = "returns_d1", *, active_only: bool = False) -> DataFrame:
    """(expr, t, ret): per date the mean of position times return over all instruments, missing and infinite as 0.

    One aggregation for all columns; ``active_only`` divides by the instruments with a position instead."""
    total = lambda c: F.count(F.when(fin(F.col(c)).isNotNull(), 1)) if active_only else F.count(F.lit(1))
    sums = [F.try_divide(F.sum(_clean(F.col(c)) * _clean(F.col(returns))), total(c)).alias(c) for c in names]
    return positions.groupBy("t").agg(*sums).unpivot("t", names, "expr", "ret").select("expr", "t", "ret")


def portfolio(pool: DataFrame) -> DataFrame:
    """(t, port): equal-weight mean of all series."""
    return pool.groupBy("t").agg(F.avg("ret").alias("port"))


def utility(pool: DataFrame) -> DataFrame:
    return pool.groupBy("expr").agg((F.avg("ret") / F.greatest(F.stddev_pop("ret"), F.lit(STD_FLOOR))).alias("utility"))


def _correlation(x: str, y: str) -> Column:
    return F.covar_pop(x, y) / F.greatest(F.stddev_pop(x) * F.stddev_pop(y), F.lit(STD_FLOOR))


def correlation_to_portfolio(pool: DataFrame) -> DataFrame:
    return pool.join(portfolio(pool), "t").groupBy("expr").agg(_correlation("ret", "port").alias("corr"))


class _Block:
    """Series as rows, without their means; ``scale`` holds their deviations."""

    def __init__(self, series):
        self.dates = {s["dates"] for s in series}
        if len(self.dates) > 1:
            raise ValueError(OTHER_DATES)
        self.expr = np.array([s["expr"] for s in series], dtype=object)
        x = np.array([list(s["vals"]) for s in series], dtype=float)
        self.x = x - x.mean(axis=1, keepdims=True)
        self.scale = np.maximum(np.sqrt((self.x * self.x).mean(axis=1)), STD_FLOOR)


def _block_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[_Block, _Block, bool]]:
    """The pairs of blocks of a task, and whether they are one and the same."""
    for f in frames:
        for same, left, right in zip(f["same"], f["left"], f["right"]):
            a = _Block(left)
            b = a if same else _Block(right)
            if a.dates != b.dates:
                raise ValueError(OTHER_DATES)
            yield a, b, same


def _product(a: _Block, b: _Block) -> np.ndarray:
    """Correlations of every series of one block with every one of the other."""
    return np.einsum("it,jt->ij", a.x, b.x) / a.x.shape[1] / (a.scale[:, None] * b.scale[None, :])


def _largest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(expr, corr): of each series that a task has met, the largest correlation there."""
    best: dict[str, float] = {}
    for a, b, same in _block_pairs(frames):
        c = _product(a, b)
        if same:
            np.fill_diagonal(c, -np.inf)
        for expr, found in ((a.expr, c.max(axis=1)), (b.expr, c.max(axis=0))):
            for e, v in zip(expr.tolist(), found.tolist()):
                best[e] = max(v, best.get(e, -np.inf))
    if best:
        yield pd.DataFrame({"expr": list(best), "corr": list(best.values())})


def _matches(least: float, signed: bool):
    """(expr_a, expr_b, corr) of the pairs whose correlation (its size, if not ``signed``) is ``least`` or more.

    A quarter of the dates is multiplied first; what the other dates can add to a pair is bounded by the lengths of what
    is left of its two series, so only pairs that can still reach ``least`` are finished."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b, same in _block_pairs(frames):
            n = a.x.shape[1]
            head = n // 4
            rest = [np.sqrt((k.x[:, head:] ** 2).sum(axis=1)) for k in (a, b)]
            first = np.einsum("it,jt->ij", a.x[:, :head], b.x[:, :head])
            reach = (first if signed else np.abs(first)) + rest[0][:, None] * rest[1][None, :]
            alive = reach / n / (a.scale[:, None] * b.scale[None, :]) >= least - 1e-9
            if same:
                alive &= ~np.tri(len(a.expr), dtype=bool)
            i, j = np.nonzero(alive)
            if len(i) > alive.size // 8:
                c = _product(a, b)[i, j]
            else:
                c = np.array([a.x[p] @ b.x[q] for p, q in zip(i, j)]) / n / (a.scale[i] * b.scale[j])
            stays = (c if signed else np.abs(c)) >= least
            i, j, c = i[stays], j[stays], c[stays]
            swap = a.expr[i] > b.expr[j]
            yield pd.DataFrame({"expr_a": np.where(swap, b.expr[j], a.expr[i]), "expr_b": np.where(swap, a.expr[i], b.expr[j]), "corr": c})

    return run


def _upper(a: _Block, b: _Block, same: bool) -> np.ndarray:
    """The pair's part of the correlation matrix's upper triangle with its diagonal, rounded."""
    c = _product(a, b)
    return np.round(c[np.triu_indices(len(c))] if same else c.ravel(), 9)


def _range(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lo, hi): the ends of a task's correlations, if it has any."""
    ends = [(c.min(), c.max()) for c in (_upper(*pair) for pair in _block_pairs(frames)) if c.size]
    if ends:
        yield pd.DataFrame({"lo": [min(x for x, _ in ends)], "hi": [max(x for _, x in ends)]})


def _binned(lo: float, hi: float, bins: int):
    """(bin, n) of a task's correlations."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(bins, dtype=np.int64)
        for pair in _block_pairs(frames):
            c = _upper(*pair)
            at = np.floor((c - lo) / (hi - lo) * bins).astype(np.int64) if hi > lo else np.zeros(len(c), dtype=np.int64)
            total += np.bincount(np.minimum(at, bins - 1), minlength=bins)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bin": held.astype(np.int32), "n": total[held]})

    return run


def _pairs_of_blocks(pool: DataFrame, size: int | None = None) -> DataFrame:
    """(same, left, right): every pair of blocks of about ``SERIES_PER_BLOCK`` series that travel as arrays; ``size`` is how
    many series there are, if that is known.  What the pairs give is reduced where they are multiplied."""
    series = pool.groupBy("expr").agg(F.array_sort(F.collect_list(F.struct("t", "ret"))).alias("s"))
    series = series.select("expr", F.transform("s", lambda x: x["ret"]).alias("vals"), F.xxhash64(F.transform("s", lambda x: x["t"])).alias("dates"))
    blocks = max(1, -(-(pool.select("expr").distinct().count() if size is None else size) // SERIES_PER_BLOCK))
    packed = series.groupBy(F.pmod(F.xxhash64("expr"), F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("expr", "vals", "dates")).alias("left"))
    left = packed.withColumn("c", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))))
    pairs = left.join(packed.select(F.col("b").alias("c"), F.col("left").alias("right")), "c")
    return pairs.select((F.col("b") == F.col("c")).alias("same"), "left", "right")


def pair_correlations(pool: DataFrame) -> DataFrame:
    """(expr_a, expr_b, corr) of every two different series, expr_a < expr_b: as many rows as there are pairs.  All must have
    the same dates, else this and all that is made of pairs raises."""
    return _pairs_of_blocks(pool).mapInPandas(_matches(-np.inf, True), "expr_a string, expr_b string, corr double")


def max_correlation(pool: DataFrame, size: int | None = None) -> DataFrame:
    """(expr, maxcorr): the largest signed correlation with another series; missing for a lone one.  Tasks give the maxima of
    the series that they have met, not pairs."""
    found = _pairs_of_blocks(pool, size).mapInPandas(_largest, "expr string, corr double")
    return found.groupBy("expr").agg(F.max(F.when(F.col("corr") > float("-inf"), F.col("corr"))).alias("maxcorr"))


def near_copies(pool: DataFrame, distance: float, *, signed: bool = False) -> DataFrame:
    """Pairs of series whose distance 1 - |corr| (1 - corr if ``signed``) is at most ``distance``; only they leave the tasks."""
    c = F.col("corr") if signed else F.abs("corr")
    found = _pairs_of_blocks(pool).mapInPandas(_matches(1 - distance - 1e-12, signed), "expr_a string, expr_b string, corr double")
    return found.withColumn("dist", 1 - c).filter(F.col("dist") <= distance)


def correlation_histogram(pool: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, n): equal-width counts of the correlation matrix's upper triangle with its diagonal.  A first pass finds the
    ends, a second counts; both give a row or some bins for each task."""
    pairs = settled(_pairs_of_blocks(pool))
    ends = pairs.mapInPandas(_range, "lo double, hi double").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    counts = pairs.mapInPandas(_binned(ends["lo"] or 0.0, ends["hi"] or 0.0, bins), "bin int, n long")
    return counts.groupBy("bin").agg(F.sum("n").alias("n"))


def _ratio(mean: Column, std: Column) -> Column:
    return clamp(mean / F.greatest(std, F.lit(SLICE_FLOOR)), -UTILITY_LIMIT, UTILITY_LIMIT)


def _in_slice(skip_start: int, skip_end: int, periods: int | None) -> Column:
    held = F.col("t") >= skip_start
    if skip_end:
        if periods is None:
            raise ValueError("skip_end needs the number of periods")
        held = held & (F.col("t") < periods - skip_end)
    return held


def _old_utility(base: DataFrame) -> DataFrame:
    """One row (old) from (t, port)."""
    return base.agg(F.coalesce(_ratio(F.avg("port"), F.stddev_pop("port")), F.lit(0.0)).alias("old"))


def _mixed(size: int) -> Column:
    """The portfolio's return with one more series in it."""
    return F.coalesce(F.col("port"), F.lit(0.0)) * (size / (size + 1)) + F.col("ret") / (size + 1) if size else F.col("ret")


def _gain(size: int) -> Column:
    return (F.col("new") - DISCOUNT * F.col("old")) * (size + 1)


def marginal_utility(candidates: DataFrame, pool: DataFrame, *, skip_start: int = SKIP_START, skip_end: int = 0, periods: int | None = None) -> DataFrame:
    """(expr, mu): what adding each candidate to the pool's portfolio does to its utility, on the dates from
    ``skip_start`` on, without the last ``skip_end`` of ``periods``."""
    held = _in_slice(skip_start, skip_end, periods)
    size = pool.select("expr").distinct().count()
    base = portfolio(pool).filter(held)
    new = candidates.filter(held).join(base, "t", "left").groupBy("expr").agg(_ratio(F.avg(_mixed(size)), F.stddev_pop(_mixed(size))).alias("new"))
    return new.join(F.broadcast(_old_utility(base))).select("expr", _gain(size).alias("mu"))  # old is one row


def pool_stats(pool: DataFrame, *, skip_start: int = SKIP_START, skip_end: int = 0, periods: int | None = None, written: bool = False) -> DataFrame:
    """(expr, utility, mu, corr, maxcorr).  The pool is written once, so what made it is evaluated once (``written``: it has been
    already); then one window by date and one aggregation by expression give all but the pair correlations."""
    pool, held = pool if written else settled(pool), _in_slice(skip_start, skip_end, periods)
    size = pool.select("expr").distinct().count()
    marked = pool.withColumn("port", F.avg("ret").over(Window.partitionBy("t")))
    mixed = F.when(held, _mixed(size))
    stats = marked.groupBy("expr").agg(
        (F.avg("ret") / F.greatest(F.stddev_pop("ret"), F.lit(STD_FLOOR))).alias("utility"), _correlation("ret", "port").alias("corr"), _ratio(F.avg(mixed), F.stddev_pop(mixed)).alias("new")
    )
    stats = stats.join(F.broadcast(_old_utility(portfolio(pool).filter(held)))).withColumn("mu", _gain(size))  # old is one row
    return stats.join(max_correlation(pool, size), "expr").select("expr", "utility", "mu", "corr", "maxcorr")


def add_new(pool: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pool with the candidates whose expression it does not hold; of repeated dates one row stays."""
    fresh = candidates.join(pool.select("expr").distinct(), "expr", "left_anti").dropDuplicates(["expr", "t"])
    return pool.unionByName(fresh)


def best(stats: DataFrame, by: str, k: int) -> DataFrame:
    """The k expressions with the largest value."""
    return stats.orderBy(F.desc_nulls_last(by), "expr").limit(k)


def potentials(scored: DataFrame) -> DataFrame:
    """From (step, expr, mu): (step, potential, reward).  The potential is exp(best mu) - 1; the reward its change.

    A step without candidates has potential 0 and reward -0.1; a step with a missing mu is invalid (both missing)."""
    steps = scored.groupBy("step").agg(F.max("mu").alias("best"), F.count("expr").alias("n"), F.count(F.when(F.col("expr").isNotNull() & F.col("mu").isNull(), 1)).alias("bad"))
    potential = F.when(F.col("n") == 0, F.lit(0.0)).when(F.col("bad") == 0, exp_utility(F.col("best")))
    steps = steps.select("step", "n", potential.alias("potential"))
    # One row a step: the window's single group is as long as the search's step counter, not as the data.
    before = F.lag("potential", 1, 0.0).over(Window.partitionBy(F.lit(0)).orderBy("step"))
    return steps.select("step", "potential", F.when(F.col("n") == 0, F.lit(-0.1)).otherwise(F.col("potential") - F.coalesce(before, F.lit(0.0))).alias("reward"))


def fitness(metrics: DataFrame, weights: dict[str, tuple[float, float, float]]) -> DataFrame:
    """From (expr, metric, value): the weighted sum of piecewise scores; a metric that is absent adds 0.
    ``weights``: metric -> (weight, a, b)."""
    score = F.lit(0.0)
    for metric, (w, a, b) in weights.items():
        score = F.when(F.col("metric") == metric, w * piecewise_score(F.col("value"), a, b)).otherwise(score)
    return metrics.groupBy("expr").agg(F.sum(F.coalesce(score, F.lit(0.0))).alias("fitness"))


def data_quality(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per series: how many values, and how many missing, infinite and zero ones."""
    x = F.col(value).cast("double")
    lost = x.isNull() | F.isnan(x)
    return rows.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(lost).alias("missing"), F.count_if(~lost & is_inf(x)).alias("infinite"), F.count_if(x == 0).alias("zero")
    )


def long_short_returns(panel: DataFrame, position: str, price: str, *, book: float = 10_000_000.0, fee: float = 0.0005) -> DataFrame:
    """(t, pnl, turnover, position, log_return) of longs and shorts each scaled to ``book``, held in whole shares to the next date.

    Turnover is the change of the positions' values as a share of ``book``, the return what is left of the gain after fees as a
    share of the positions' values; on a date without a next price both gain and return are missing."""
    date, inst = Window.partitionBy("t"), Window.partitionBy("inst").orderBy("t")
    p = _clean(F.col(position))
    side = F.sum(F.when(p > 0, p).otherwise(0.0)).over(date), F.sum(F.when(p < 0, -p).otherwise(0.0)).over(date)
    scaled = F.when(p > 0, F.try_divide(p, side[0])).when(p < 0, F.try_divide(p, side[1])).otherwise(0.0) * book
    held = panel.select("t", "inst", F.col(price).alias("price"), scaled.alias("dollars")).withColumn("shares", F.coalesce(F.round(F.try_divide("dollars", F.col("price"))), F.lit(0.0)))
    held = held.withColumn("value", F.coalesce(F.col("shares") * F.col("price"), F.lit(0.0)))
    held = held.withColumn("gain", F.col("shares") * F.lead("price").over(inst) - F.col("value")).withColumn("traded", F.abs(F.col("value") - F.coalesce(F.lag("value").over(inst), F.lit(0.0))))
    sums = held.groupBy("t").agg(F.sum("gain").alias("gain"), F.sum("traded").alias("traded"), F.sum(F.abs("value")).alias("position"))
    pnl = F.col("gain") - fee * F.col("traded")
    return sums.select("t", pnl.alias("pnl"), (F.col("traded") / book).alias("turnover"), "position", F.log1p(F.try_divide(pnl, F.col("position"))).alias("log_return"))


def sharpe(returns: DataFrame, *, value: str = "log_return", per_year: float = 252.0) -> DataFrame:
    """One row (sharpe, ret, turnover) of such returns: mean over population deviation, a year's worth (0 where there is no
    deviation), their sum, and the mean turnover."""
    std = F.stddev_pop(value)
    return returns.agg(
        F.when(std > 1e-10, F.avg(value) / std * per_year**0.5).otherwise(0.0).alias("sharpe"), F.coalesce(F.sum(value), F.lit(0.0)).alias("ret"), F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover")
    )
