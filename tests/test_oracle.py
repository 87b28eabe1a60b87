"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["op_divide", "op_rank", "op_rank_div", "op_cs_zscore", "op_ts_argmin", "op_ts_corr", "op_ts_sum_day", "expr_mixed_deep", "pool_stats", "slot_batch", "slot_weighted", "transition_matrix", "candles", "portfolio_weights", "quantile_by_bucket", "observed_adv20", "op_ts_corr_day", "op_ts_rank_long_day", "op_ts_sum_spike_day", "op_ts_mean_spike_day", "op_ts_max_long_day", "op_ts_argmin_long_day", "op_ts_stddev_long_day", "op_ts_cov_long_day", "op_ts_corr_long_day", "op_ts_cov_day", "op_ts_stddev_inf", "op_cs_zscore_inf", "op_ts_corr_inf", "data_quality", "op_ts_max_inf", "long_short", "long_short_sharpe", "trajectory_medians", "text_huffman", "stage_sampling", "exact_stages", "weighted_stages", "quantile_prices", "corr_hist", "matrix_round_trip", "catalogue_round_trip", "candles_round_trip", "search_log_round_trip", "stream_signals", "stream_formulas", "stream_bars", "user_operator"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    want = sorted(repr(tuple(dict(zip(found.columns, r))[c] for c in columns)) for r in found.fetchall())
    assert got == want


def test_entry_and_registry(spark):
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        out = entry.entry(spark)
        assert out.columns == ["t", "inst", "value"] and out.count() == 830


@pytest.mark.parametrize("name", ["op_ts_return", "op_observed_return"])
def test_rounding_has_one_rule(spark, name):
    """Numbers whose seventh decimal is their last and a 5, of both signs, infinities, and what has no decimals."""
    from pyspark.sql import functions as F

    from panelspark.queries import tidy

    values = [s * float(f"{k}.{(k * 37) % 1000000:06d}5") for k in range(3000) for s in (1, -1)] + [math.inf, -math.inf, 1e300, 12345678901234567890.0, -1e-7, 5e-7, None]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v double").withColumn("r", tidy(F.col("v"))).toArrow()  # noqa: F841  DuckDB finds it by name
    rule = ORACLES[name].split("SELECT t, inst, ")[-2].split(" AS value")[0]
    assert duckdb.sql(f"SELECT k, v, r FROM rows WHERE r IS DISTINCT FROM ({rule})").fetchall() == []


def test_seven_digits_without_text(spark):
    """Numbers of all sizes, next to powers of ten and to halves of the seventh digit, infinities, zeros and nothing; and the
    daily queries do not write every row as text."""
    from pyspark.sql import functions as F

    from panelspark.queries import UNTIE, significant, with_significant

    edges = [s * d * 10.0**k / UNTIE for k in range(-12, 40) for s in (1, -1) for d in (1, 1.0000005, 1.2345675, 0.9999999499999999, 0.99999995, 0.9999999999999999)]
    values = edges + [math.inf, -math.inf, None, 0.0, -0.0, 1e-9, 9.99e-10, 5e-324, 1.7e308, 1e22, 1e23] + [k / 7 - 500 for k in range(5000)]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, value double")
    both = with_significant(rows.withColumn("text", significant(F.col("value"))))
    assert both.columns == ["k", "value", "text"] and both.count() == len(values)
    assert both.filter(~F.col("value").eqNullSafe(F.col("text"))).collect() == []
    plan = QUERIES["op_ts_mean_day"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LOG10" in plan
