import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import pool as P
from panelspark.operators import results as R


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(0)
    base = rng.standard_normal(60) * 0.01
    return {"a": base, "b": base + rng.standard_normal(60) * 0.001, "c": rng.standard_normal(60) * 0.02, "d": -base}


@pytest.fixture(scope="module")
def pool(spark, series):
    return spark.createDataFrame([(k, t, float(v)) for k, vs in series.items() for t, v in enumerate(vs)], "expr string, t int, ret double")


def test_backtest_counts_every_instrument(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 0.5), (0, 1, None, 0.5), (0, 2, float("inf"), 1.0), (0, 3, 2.0, None)], "t int, inst int, p double, returns_d1 double")
    assert P.backtest(df, ["p"]).first().ret == 0.125
    assert P.backtest(df, ["p"], active_only=True).first().ret == 0.25


def test_pool_statistics(pool, series):
    port = np.mean(list(series.values()), axis=0)
    stats = {r.expr: r for r in P.pool_stats(pool, skip_start=10).collect()}
    for k, v in series.items():
        assert stats[k].utility == pytest.approx(v.mean() / v.std())
        assert stats[k].corr == pytest.approx(np.corrcoef(v, port)[0, 1])
        assert stats[k].maxcorr == pytest.approx(max(np.corrcoef(v, w)[0, 1] for j, w in series.items() if j != k))
        p, r = port[10:], v[10:]
        clip = lambda x: max(-10, min(10, x))
        new = p * 4 / 5 + r / 5
        assert stats[k].mu == pytest.approx((clip(new.mean() / new.std()) - 0.9 * clip(p.mean() / p.std())) * 5)


def test_pool_edges(spark, pool):
    lone = pool.filter("expr = 'a'")
    assert P.max_correlation(lone).first().maxcorr is None
    none = pool.filter("expr = 'zz'")
    alone = {r.expr: r.mu for r in P.marginal_utility(lone, none, skip_start=0).collect()}
    v = np.array([r.ret for r in lone.orderBy("t").collect()])
    assert alone["a"] == pytest.approx(v.mean() / v.std())
    assert {(r.expr_a, r.expr_b) for r in P.near_copies(pool, 0.05).collect()} == {("a", "b"), ("a", "d"), ("b", "d")}
    assert P.correlation_histogram(pool, 30).agg({"n": "sum"}).first()[0] == 10
    assert P.add_new(lone, pool).select("expr").distinct().count() == 4 and P.add_new(lone, pool).count() == 240
    assert P.best(P.utility(pool), "utility", 2).count() == 2


def test_series_of_other_dates_are_refused(spark, pool):
    with pytest.raises(Exception, match="other dates"):
        P.max_correlation(pool.filter("expr <> 'a' or t > 0")).collect()


def test_sharpe(spark):
    logs = [0.01, -0.02, 0.03, 0.005]
    r = P.sharpe(spark.createDataFrame([(x, 0.5) for x in logs] + [(None, 1.0)], "log_return double, turnover double")).first()
    assert r.sharpe == pytest.approx(np.mean(logs) / np.std(logs) * math.sqrt(252)) and r.ret == pytest.approx(sum(logs)) and r.turnover == pytest.approx(0.6)
    assert P.sharpe(spark.createDataFrame([(0.1, 0.5)] * 2, "log_return double, turnover double")).first().sharpe == 0.0


def test_potentials_and_fitness(spark):
    rows = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.5), (2, None, None), (3, "c", 0.1), (4, "d", None)], "step int, expr string, mu double")
    got = {r.step: (r.potential, r.reward) for r in P.potentials(rows).collect()}
    assert got[1] == pytest.approx((math.expm1(0.5), math.expm1(0.5))) and got[2] == (0.0, -0.1)
    assert got[3][1] == pytest.approx(math.expm1(0.1)) and got[4][0] is None
    m = spark.createDataFrame([("e", "Sharpe", 0.5), ("e", "Ret", 3.0), ("f", "Sharpe", -1.0)], "expr string, metric string, value double")
    fit = {r.expr: r.fitness for r in P.fitness(m, {"Sharpe": (1.0, 0.0, 1.0), "Ret": (2.0, 0.0, 2.0)}).collect()}
    assert fit == pytest.approx({"e": 0.5 + 2 * (1 + 0.1 * 0.5 * 1), "f": 10.0})


def test_data_quality(spark):
    df = spark.createDataFrame([("k", None), ("k", float("nan")), ("k", float("inf")), ("k", 0.0), ("k", 1.0)], "k string, v double")
    assert tuple(P.data_quality(df, "k", "v").first()) == ("k", 5, 2, 1, 1)


def test_sequences(spark):
    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "x"), (2, 0, "x")], "seq_id int, step int, token string")
    t = {(r.prev, r.next): (r.n, r.p) for r in R.transitions(rows).collect()}
    assert t == {("0", "x"): (2, 1.0), ("x", "y"): (1, 1.0), ("y", "x"): (1, 1.0)}
    f = {r.seq_id: r for r in R.sequence_features(rows, data_tokens=["x"], op_tokens=["y"], done="y").collect()}
    assert f[1].entropy == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3))) and (f[1].done, f[2].done) == (1, 0)
    assert f[1].length == pytest.approx(0.1)


def test_text_sizes(spark):
    assert R.huffman_bits("") == 0 and R.huffman_bits("aaaa") == 4 and R.huffman_bits("aabc") == 6
    row = spark.createDataFrame([("aabc",), (None,)], "s string").select(R.huffman_length("s").alias("h"), R.gzip_length("s").alias("g")).collect()
    assert row[0].h == 6 and row[1].h == 0 and row[1].g == 20


def test_text_sizes_hold_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([chr(97 + k % 20) * 50_000 for k in range(200)] + [None, ""])
    for size in (R.huffman_length, R.gzip_length):
        tracemalloc.start()
        found = size.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 202 and found[0].as_py() > 0 and peak < 2_000_000


def test_portfolios_and_trajectories(spark):
    returns = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.0), (1, 1, -0.1), (1, 2, 0.2), (2, 1, None), (2, 2, 0.5)], "t int, inst int, ret double")
    weights = spark.createDataFrame([("p", 1, 0.5), ("p", 2, 0.5)], "pid string, inst int, w double")
    r = R.weighted_portfolios(returns, weights).first()
    assert r.arith == pytest.approx(0.05) and r.geo == pytest.approx(0.05) and r.std == pytest.approx(0.0, abs=1e-12)
    rows = spark.createDataFrame([("k", [float(i * i) for i in range(25)]), ("short", [1.0])], "key string, v array<double>")
    steps = R.trajectory_steps(rows, key="key", values="v")
    assert tuple(R.trajectory_medians(steps, key="key").first()) == (19.0, 19.0)
    assert steps.count() == 19 and R.trajectory_summary(steps, key="key")[1].first().mean_diff == pytest.approx(19.0)


def many_series(spark, n=40, dates=60, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dates))
    x = {f"e{i}": base[i % 6] * rng.choice([1, -1]) + rng.normal(size=dates) * rng.choice([0.01, 0.3, 3]) for i in range(n)}
    x["flat"] = np.zeros(dates)
    return x, spark.createDataFrame([(e, t, float(v)) for e, s in x.items() for t, v in enumerate(s)], "expr string, t int, ret double")


def correlations(x):
    names = sorted(x)
    centred = {e: v - v.mean() for e, v in x.items()}
    std = {e: max(np.sqrt((v * v).mean()), 1e-9) for e, v in centred.items()}
    return {(a, b): (centred[a] * centred[b]).mean() / (std[a] * std[b]) for i, a in enumerate(names) for b in names[i + 1 :]}


def test_pairs_are_reduced_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "SERIES_PER_BLOCK", 7)
    x, pool = many_series(spark)
    want = correlations(x)
    got = {(r.expr_a, r.expr_b): r.corr for r in P.pair_correlations(pool).collect()}
    assert set(got) == set(want) and all(abs(got[k] - c) < 1e-12 for k, c in want.items())
    best = {e: max(c for k, c in want.items() if e in k) for e in x}
    assert all(abs(r.maxcorr - best[r.expr]) < 1e-12 for r in P.max_correlation(pool).collect())
    for signed in (False, True):
        for distance in (0.05, 0.5, 1.2):
            near = {k for k, c in want.items() if 1 - (c if signed else abs(c)) <= distance}
            assert {(r.expr_a, r.expr_b) for r in P.near_copies(pool, distance, signed=signed).collect()} == near
    every = np.round([*want.values(), *[1.0 if x[e].any() else 0.0 for e in x]], 9)
    at = np.minimum(np.floor((every - every.min()) / (every.max() - every.min()) * 20), 19).astype(int)
    assert {r.bin: r.n for r in P.correlation_histogram(pool, 20).collect()} == {int(b): int((at == b).sum()) for b in set(at)}
    alone = pool.filter("expr = 'e1'")
    assert [tuple(r) for r in P.max_correlation(alone).collect()] == [("e1", None)] and P.near_copies(alone, 1.0).isEmpty()
    with pytest.raises(Exception, match="other dates"):
        P.max_correlation(pool.filter("expr <> 'e1' or t > 3")).collect()


@pytest.mark.parametrize("q, enough", [(0.25, 10), (0.999, 10), (0.5, 10_000), (1.0, 10_000)])
def test_quantiles_by_narrowing(spark, q, enough):
    rng = random.Random(9)
    inf = math.inf
    rows = [("a", rng.uniform(0, 1)) for _ in range(500)] + [("b", rng.choice([1.0, 2.0, 1e300, -1e300])) for _ in range(200)] + [(None, 10.0**k) for k in range(-150, 150)]
    rows += [("c", 5.0)] * 90 + [("d", rng.choice([inf, -inf, 0.0, 3.5])) for _ in range(99)] + [("e", None), ("f", math.nan), ("a", None), ("g", 1.0), ("h", 1.0), ("h", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(v for own, v in rows if own == k and v is not None and v == v)
        at = (len(v) - 1) * q
        low = math.floor(at)
        want[k] = None if not v else v[low] if at == low or v[low] == v[low + 1] else (1 - (at - low)) * v[low] + (at - low) * v[low + 1]
    got = {r.bucket: r.q for r in R.quantile_by_bucket(df, F.col("k"), "v", q, bins=64, enough=enough).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == v or v is not None and (v != v and got[k] != got[k] or abs(got[k] - v) <= 1e-12 * abs(v)), (k, got[k], v)
    assert R.quantile_by_bucket(df.limit(0), F.col("k"), "v", q).isEmpty()


def test_exact_stages(spark, monkeypatch):
    monkeypatch.setattr(R, "RANKED", 10)
    df = spark.createDataFrame([(i, "x") for i in range(1000)], "id long, __h string")
    got = R.exact_stages(df, F.col("id"), 7, 0.13)
    assert got.columns == ["id", "__h", "stage"]
    rows = got.collect()
    order = sorted(range(1000), key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), str(i)))
    assert {r.id: r.stage for r in rows} == {i: k // 130 for k, i in enumerate(order) if k < 910} and len(rows) == 910
    assert R.exact_stages(df, F.col("id"), 3, 0.0001).isEmpty() and R.exact_stages(df.limit(0), F.col("id"), 3, 0.1).isEmpty()
    with pytest.raises(ValueError):
        R.exact_stages(df, F.col("id"), 3, 0.5)


def test_exact_stages_with_clashing_names_and_missing_keys(spark):
    df = spark.createDataFrame([(i if i % 10 else None, 1, 2, 3, 4) for i in range(300)], "id long, `of` int, first int, last int, __at int")
    rows = R.exact_stages(df, F.col("id"), 3, 0.2).collect()
    order = sorted((i for i in range(300) if i % 10), key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), str(i)))
    assert {r.id: r.stage for r in rows} == {i: k // 54 for k, i in enumerate(order) if k < 162} and rows[0]["of"] == 1 and rows[0]["__at"] == 4


@pytest.mark.parametrize("ranked", [10, 100_000])
def test_weighted_stages(spark, monkeypatch, ranked):
    monkeypatch.setattr(R, "RANKED", ranked)
    odd = {0: None, 1: 0.0, 2: -1.0, 3: float("nan"), 4: float("inf")}
    weights = {i: odd.get(i, [1e-200, 0.5, 1.0, 3.0, 1e200][i % 5]) for i in range(1000)}
    df = spark.createDataFrame([(i, w, i) for i, w in weights.items()] + [(None, 1.0, 0)], "id long, w double, stage_of long")
    wait = lambda i: -math.log((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) + 0.5) / 2**32) / weights[i]
    order = sorted((i for i in range(5, 1000)), key=lambda i: (wait(i), str(i)))
    size = int(995 * 0.13)
    got = R.weighted_stages(df, F.col("id"), F.col("w"), 7, 0.13)
    assert got.columns == ["id", "w", "stage_of", "stage"]
    rows = got.collect()
    assert {r.id: r.stage for r in rows} == {i: k // size for k, i in enumerate(order) if k < 7 * size} and len(rows) == 7 * size
    assert R.weighted_stages(df.limit(0), F.col("id"), F.col("w"), 2, 0.5).isEmpty()
    with pytest.raises(ValueError):
        R.weighted_stages(df, F.col("id"), F.col("w"), 3, 0.5)


def test_weights_are_chances(spark):
    df = spark.range(8000).withColumn("w", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0))
    first = R.weighted_stages(df, F.col("id"), F.col("w"), 1, 0.05).groupBy("w").count().collect()
    n = {r.w: r["count"] for r in first}
    assert n[3.0] + n[1.0] == 400 and abs(n[3.0] / 400 - 0.75) < 0.07
