"""Operators across the instruments of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fin, fin0, ieee_div, nz
from ..sources.scratch import few, settled
from .registry import CROSS, PANEL, register


def date():
    """The window of a date's cells."""
    return Window.partitionBy("t")


def sum_of_squares(x: Column, mean: Column, window) -> Column:
    """Squared deviations from ``mean`` over a window, infinite values counting as no deviation."""
    n = F.count(fin(x)).over(window)
    own = F.avg(fin(x)).over(window)
    return F.coalesce(n * F.var_pop(fin(x)).over(window) + n * F.pow(own - mean, F.lit(2.0)), F.lit(0.0))


def rank(x: Column) -> Column:
    """Average-tie rank among what is there, scaled to [0, 1]; a lone value has rank 0."""
    order = date().orderBy(x.asc_nulls_last())
    low = F.rank().over(order)
    high = F.count(x).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), ((low + high) / 2 - 1) / F.greatest(F.count(x).over(date()) - 1, F.lit(1)))


def rank_by_ranges(panel: DataFrame, field: str, name: str, *, ranges: int = 64) -> DataFrame:
    """``panel`` with ``name``, the rank of ``field`` in its date, for dates with more cells than one task should sort.

    Equal values of a date are counted first; each date's distinct values are dealt to ranges between its approximate
    quantiles, and a rank is what lies below the range plus the place inside.  Cuts are written, since approximate quantiles
    depend on the order in which parts arrive: worked out again they could differ from those that the sums below used.  The caller chooses this form; it gives what
    the operator ``rank`` gives."""
    v = nz(F.col(field).cast("double"))
    counts = settled(panel.select("t", v.alias("v")).filter("v is not null").groupBy("t", "v").agg(F.count("*").alias("c")))
    cuts = settled(counts.groupBy("t").agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts"), F.sum("c").alias("n")))
    placed = counts.join(few(cuts), "t").withColumn("r", F.size(F.filter("cuts", lambda s: s < F.col("v")))).drop("cuts")
    below = Window.partitionBy("t").orderBy("r")  # as many rows as there are ranges
    sums = placed.groupBy("t", "r").agg(F.sum("c").alias("held")).withColumn("below", F.sum("held").over(below) - F.col("held")).drop("held")
    upto = F.sum("c").over(Window.partitionBy("t", "r").orderBy("v")) + F.col("below")
    ranked = placed.join(few(sums), ["t", "r"]).select(F.col("t").alias("__t"), F.col("v").alias("__v"), ((upto - F.col("c") + 1 + upto) / 2 - 1).alias("place"), "n")
    out = panel.join(ranked, (F.col("t") == F.col("__t")) & (v == F.col("__v")), "left")
    return out.withColumn(name, F.col("place") / F.greatest(F.col("n") - 1, F.lit(1))).drop("__t", "__v", "place", "n")


def zscore(x: Column) -> Column:
    n = F.count(x).over(date())
    mean = F.try_divide(F.sum(fin0(x)).over(date()), n)
    return nz((x - mean) / (F.sqrt(F.try_divide(sum_of_squares(x, mean, date()), n)) + 1e-10))


register("rank", (PANEL,), CROSS, rank)
register("cs_rank", (PANEL,), CROSS, rank)
register("rank_add", (PANEL, PANEL), CROSS, lambda a, b: rank(a) + rank(b))
register("rank_sub", (PANEL, PANEL), CROSS, lambda a, b: rank(a) - rank(b))
register("rank_mul", (PANEL, PANEL), CROSS, lambda a, b: rank(a) * rank(b))
register("rank_div", (PANEL, PANEL), CROSS, lambda a, b: nz(ieee_div(rank(a), rank(b))))
register("cs_zscore", (PANEL,), CROSS, zscore)
register("count_valid", (PANEL,), CROSS, lambda a: F.count(a).over(date()).cast("double"))
