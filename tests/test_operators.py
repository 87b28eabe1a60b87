"""Fixed vectors, brute force on a panel with gaps and infinities, and properties that every operator keeps."""

import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import OPERATORS
from panelspark.operators.cross_section import rank_by_ranges
from panelspark.operators.registry import FLOAT, INT, PANEL, TRAIL
from panelspark.plans import data, evaluate, op

N = None
SCHEMA = "t int, inst long, x double, y double"
#: Fixed vectors of one instrument: operator, scalars, input, output.
VECTORS = [
    ("ts_argmax", (2,), [1, 3, N, 2, 5], [0, 0, 1, 2, 0]),
    ("ts_argmin", (2,), [3, 1, N, 2, 5], [0, 0, 1, 2, 1]),
    ("ts_max", (3,), [1, N, 3, 2, 5, N], [1, 1, 3, 3, 5, 5]),
    ("ts_min", (3,), [1, N, 3, 2, 5, N], [1, 1, 1, 2, 2, 2]),
    ("ts_sum", (3,), [1, N, 3, 2, 5], [1, 1, 4, 5, 10]),
    ("ts_prod", (3,), [2, N, 3, 2, 5], [2, 2, 6, 6, 30]),
    ("ts_nanmean", (3,), [2, N, 4, 2, 6], [2, 2, 3, 3, 4]),
    ("ts_mean", (3,), [2, 4, 6, 8, 10], [2, 3, 4, 6, 8]),
    ("ts_stddev", (3,), [2, 4, N, 8, 10], [N, 2**0.5, 2**0.5, 8**0.5, 2**0.5]),
    ("ts_rank", (3,), [1, 3, 2, N, 5], [1, 1, 2 / 3, N, 1]),
    ("ts_rank", (1,), [1, N], [1, 1]),
    ("delay", (-1,), [1, 2], [N, N]),
    ("delay", (0,), [1, 2], [1, 2]),
    ("ts_mean", (1,), [math.inf], [0]),
    ("ts_nanmean", (1,), [math.inf], [math.inf]),
    ("ts_return", (1,), [0, 3, 6], [N, math.inf, 1]),
    ("observed_return", (), [2, N, 3], [N, N, 0.5]),
]


def panel(spark, columns: dict[int, list], y: dict[int, list] | None = None):
    rows = [(t, i, None if v is None else float(v), None if not y or y[i][t] is None else float(y[i][t])) for i, vs in columns.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, inst=0):
    return [r.v for r in df.filter(F.col("inst") == inst).orderBy("t").collect()]


def same(a, b, tol=1e-9):
    return len(a) == len(b) and all((p is None) == (q is None) and (p is None or p == q or abs(p - q) <= tol * max(1, abs(q))) for p, q in zip(a, b))


@pytest.mark.parametrize("name,scalars,x,want", VECTORS)
def test_fixed_vectors(spark, name, scalars, x, want):
    got = values(evaluate(panel(spark, {0: x}), {"v": op(name, data("x"), *scalars)}))
    assert same(got, want), got


def test_pairs(spark):
    got = values(evaluate(panel(spark, {0: [1, 2, 3, 4]}, {0: [1, 2, 1, 2]}), {"v": op("ts_cov", data("x"), data("y"), 3)}))
    assert same(got, [N, 0.5, 0, 0])
    got = values(evaluate(panel(spark, {0: [1, 2, 3, 4]}, {0: [1, 2, 3, 4]}), {"v": op("ts_corr", data("x"), data("y"), 3)}))
    assert same(got, [N, 1, 1, 1])


def test_divide_and_cross_section(spark):
    a, b = [1, -1, 0, N, 1], [0, 0, 0, 2, 2]
    got = values(evaluate(panel(spark, {0: a}, {0: b}), {"v": op("divide", data("x"), data("y"))}))
    assert got == [1e9, -1e9, 0.0, 0.0, 0.5]
    row = {i: [v] for i, v in enumerate([1, 2, 2, N, 5])}
    df = evaluate(panel(spark, row), {"v": op("rank", data("x")), "z": op("cs_zscore", data("x"))})
    assert same([values(df, i)[0] for i in range(5)], [0, 0.5, 0.5, N, 1])
    flat = evaluate(panel(spark, {i: [3] for i in range(3)}), {"v": op("cs_zscore", data("x"))})
    assert [values(flat, i)[0] for i in range(3)] == [0.0] * 3
    lone = evaluate(panel(spark, {0: [7], 1: [N]}), {"v": op("rank", data("x"))})
    assert values(lone, 0) == [0.0] and values(lone, 1) == [None]


def stress():
    rng = random.Random(3)
    def cell():
        r = rng.random()
        return None if r < 0.2 else math.inf if r < 0.25 else -math.inf if r < 0.28 else float(rng.randint(-2, 4)) if r < 0.7 else rng.uniform(-2, 2)
    x = {i: [cell() for _ in range(40)] for i in range(6)}
    y = {i: [cell() for _ in range(40)] for i in range(6)}
    x[4] = [None] * 40
    x[5], y[5] = [1.5] * 40, [2.0] * 40
    for i in x:
        x[i][7] = None
    return x, y


def brute(name, d, x, y, t):
    """One value from the definition; x, y: an instrument's series."""
    w = [v for v in x[max(0, t - d + 1) : t + 1] if v is not None]
    finite = [v for v in w if not math.isinf(v)]
    if name in ("ts_mean", "ts_nanmean"):
        return sum(finite) / len(w) if w else None
    if name == "ts_sum":
        return sum(finite) if w else None
    if name == "ts_prod":
        return math.prod(finite) if w else None
    if name == "ts_max":
        return max(finite) if finite else None
    if name == "ts_min":
        return min(finite) if finite else None
    if name == "ts_stddev":
        if len(w) <= 1:
            return None
        m = sum(finite) / len(w)
        return math.sqrt(sum((v - m) ** 2 for v in finite) / (len(w) - 1))
    if name == "ts_rank":
        return None if x[t] is None else sum(v <= x[t] for v in w) / len(w)
    if name in ("ts_argmax", "ts_argmin"):
        span = range(max(0, t - d), t + 1)
        held = [(x[s], s) for s in span if x[s] is not None]
        if not held:
            return None
        fine = [(v, s) for v, s in held if not math.isinf(v)]
        if not fine:
            return 0.0
        extreme = (max if name == "ts_argmax" else min)(v for v, _ in fine)
        return float(t - max(s for v, s in fine if v == extreme))
    pairs = [(a, b) for a, b in zip(x[max(0, t - d + 1) : t + 1], y[max(0, t - d + 1) : t + 1]) if a is not None and b is not None]
    if len(pairs) <= 1 or any(math.isinf(v) for p in pairs for v in p):
        return None
    a, b = np.array(pairs).T
    cov = ((a - a.mean()) * (b - b.mean())).sum()
    if name == "ts_cov":
        return cov / (len(a) - 1)
    scale = math.sqrt(((a - a.mean()) ** 2).sum() * ((b - b.mean()) ** 2).sum())
    return cov / scale if scale > 1e-12 else None


def test_windows_against_brute_force(spark):
    x, y = stress()
    names = ["ts_mean", "ts_nanmean", "ts_sum", "ts_prod", "ts_max", "ts_min", "ts_stddev", "ts_rank", "ts_argmax", "ts_argmin", "ts_cov", "ts_corr"]
    formulas = {n: op(n, data("x"), *([data("y")] if OPERATORS[n].kinds[1] == PANEL else []), 5) for n in names}
    for r in evaluate(panel(spark, x, y), formulas).collect():
        for n in names:
            want = brute(n, 5, x[r.inst], y[r.inst], r.t)
            assert same([r[n]], [want], 1e-6), (n, r.inst, r.t, r[n], want)


def test_long_windows_against_brute_force(spark):
    rng = random.Random(8)
    cell = lambda: rng.choice([None, float("inf"), 0.0]) if rng.random() < 0.1 else round(rng.uniform(-1e4, 1e4), 3)
    x = {i: [cell() for _ in range(160)] for i in range(3)}
    x[3] = [None] * 160
    names, spans = ["ts_mean", "ts_nanmean", "ts_sum", "ts_rank", "ts_max", "ts_min", "ts_argmax", "ts_argmin", "ts_stddev"], (33, 50, 64, 400)
    formulas = {f"{n}{d}": op(n, data("x"), d) for n in names for d in spans} | {"nested": op("ts_rank", op("ts_mean", data("x"), 40), 35), "short": op("ts_mean", data("x"), 5)}
    frame = evaluate(panel(spark, x, x), formulas)
    mean = {i: [brute("ts_mean", 40, x[i], x[i], t) for t in range(160)] for i in x}
    for r in frame.collect():
        for n in names:
            for d in spans:
                assert same([r[f"{n}{d}"]], [brute(n, d, x[r.inst], x[r.inst], r.t)], 1e-9), (n, d, r.inst, r.t)
        assert (r["nested"] is None) == (mean[r.inst][r.t] is None) and same([r["short"]], [brute("ts_mean", 5, x[r.inst], x[r.inst], r.t)], 1e-9)
    only = evaluate(panel(spark, x, x), {"v": formulas["ts_sum50"]})
    assert only._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    part = evaluate(panel(spark, x, x), {"v": formulas["ts_sum50"]}, t_from=100, t_to=110)
    want = {(r.t, r.inst): r.v for r in only.filter("t between 100 and 110").collect()}
    assert all(same([r.v], [want[r.t, r.inst]], 1e-9) for r in part.collect())


def test_long_pairs_and_products_against_brute_force(spark):
    """Covariances about far-off means with few infinities, flat stretches, and products that neither vanish nor overflow."""
    rng = random.Random(6)
    x = {i: [None if rng.random() < 0.1 else 1e6 + rng.uniform(-1, 1) for _ in range(200)] for i in range(3)}
    y = {i: [None if rng.random() < 0.1 else rng.choice([0.5, 2.0, -1.0]) for _ in range(200)] for i in range(3)}
    x[0][50], y[1][90] = math.inf, -math.inf
    x[2][60:140] = [7.0] * 80
    formulas = {f"{n}{d}": op(n, data("x"), data("y"), d) for n in ("ts_cov", "ts_corr") for d in (33, 100)} | {"prod": op("ts_prod", data("y"), 48), "flat": op("ts_cov", data("y"), 3.0, 40)}
    for r in evaluate(panel(spark, x, y), formulas).collect():
        for d in (33, 100):
            cov, corr = (brute(n, d, x[r.inst], y[r.inst], r.t) for n in ("ts_cov", "ts_corr"))
            assert same([r[f"ts_cov{d}"]], [cov], 1e-9), (d, r.inst, r.t)
            assert same([r[f"ts_corr{d}"]], [corr], 1e-8), (d, r.inst, r.t)
        assert same([r["prod"]], [brute("ts_prod", 48, y[r.inst], y[r.inst], r.t)], 1e-12)
        assert r["flat"] in (None, 0.0)


@pytest.mark.parametrize("spike", [1e17, 1e9, -1e300])
def test_a_spike_leaves_no_trace(spark, spike, monkeypatch):
    """Windows of 32 and 33 rows after huge values: what has left a window changes nothing, and LONG changes nothing."""
    rng = random.Random(2)
    x = {0: [1.0] * 200, 1: [rng.uniform(0, 3) for _ in range(200)]}
    for i in x:
        x[i][100] = x[i][103] = spike
    formulas = {f"{n}{d}": op(n, data("x"), d) for n in ("ts_sum", "ts_mean", "ts_stddev", "ts_max", "ts_rank") for d in (32, 33, 47)}
    found = {}
    for long in (32, 1000, 2):
        monkeypatch.setattr(sys.modules[evaluate.__module__], "LONG", long)
        found[long] = {(r.t, r.inst): r for r in evaluate(panel(spark, x), formulas).collect()}
    for (t, i), r in found[32].items():
        for key in formulas:
            name, d = key[:-2], int(key[-2:])
            if name == "ts_sum" or not any(abs(v) > 1e8 for v in x[i][max(0, t - d + 1) : t + 1]):
                assert same([r[key]], [brute(name, d, x[i], x[i], t)], 1e-12), (key, t, i)
            assert same([r[key]], [found[1000][t, i][key]], 1e-12) and same([r[key]], [found[2][t, i][key]], 1e-12), (key, t, i)
    assert found[32][199, 0]["ts_sum33"] == 33 and found[32][199, 0]["ts_mean33"] == 1


@pytest.mark.parametrize("ranges", [2, 16])
def test_rank_by_ranges_equals_rank(spark, ranges):
    rng = random.Random(11)
    rows = [(t, i, rng.choice([None, math.inf, -math.inf, 3.0, math.nan, rng.uniform(-5, 5)]), 0.0) for t in range(5) for i in range(120)] + [(9, i, 1.0, 0.0) for i in range(50)] + [(10, 0, None, 0.0), (11, 0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r.t, r.inst): r.v for r in evaluate(df, {"v": op("rank", data("x"))}).collect()}
    out = rank_by_ranges(df, "x", "v", ranges=ranges)
    assert out.columns == ["t", "inst", "x", "y", "v"]
    got = {(r.t, r.inst): r.v for r in out.collect()}
    assert set(got) == set(want) and all(same([got[k]], [w], 1e-12) for k, w in want.items())


def test_rank_by_ranges_has_one_set_of_cuts(spark):
    """Approximate quantiles are not worked out again by what reads them."""
    rows = spark.range(2000).select((F.col("id") % 2).cast("int").alias("t"), F.col("id").alias("inst"), F.rand(3).alias("x"))
    plan = rank_by_ranges(rows, "x", "v", ranges=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan


@pytest.mark.parametrize("name", ["rank_add", "rank_sub", "rank_mul", "rank", "cs_rank", "cs_zscore"])
def test_daily_ranks_sort_cells_only(spark, tmp_path, name):
    """Cells that are missing take no part in the sort by date; suppliers that are not in the universe do not count."""
    from panelspark.queries import GAPPY, QUERIES, significant
    from panelspark.sources.panel import day_panel

    rows = [(k, k, k % 7, 1, float(k % 11 + 1), 100.0 * (k % 13 + 1), f"2020-01-{k * k % 28 + 1:02d}") for k in range(90)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, d string")
    lines.withColumn("l_shipdate", F.to_timestamp("d")).drop("d").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1, 9).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    out = QUERIES[f"op_{name}_day"](spark, str(tmp_path))
    whole = evaluate(day_panel(spark, str(tmp_path)), {"value": GAPPY[name][0]}).select("t", "inst", significant(F.col("value")).alias("value"))
    assert sorted(map(str, out.collect())) == sorted(map(str, whole.collect())) and out.filter("inst = 8 and value is not null").isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("rank(" if name != "cs_zscore" else "sum(")


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_cells_alone_give_the_dense_panel(spark, d):
    """Trailing operators over cells with gaps and infinities: instruments without cells, without a key and out of the
    universe; only cells are shuffled and sorted, and no window goes over dense rows."""
    from panelspark.plans import evaluate_cells
    from panelspark.sources.panel import dense

    rng = random.Random(d)
    draw_one = lambda: rng.choice([None, math.inf, -math.inf, 3.0, 3.0, rng.uniform(-5, 5)])
    rows = [(t, i, draw_one(), draw_one()) for t in range(60) for i in range(6) if rng.random() < (0.3, 0.9, 0.02, 0.5, 0.5, 0.5)[i]] + [(3, N, 1.0, 1.0)]
    cells, universe = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 7, 7, N)], "inst long")
    x, y = data("x"), op("pow", op("subtract", data("y"), 3.0), -1.0)
    formulas = {n: op(n, *((x, y) if spec.kinds.count(PANEL) == 2 else (y,)), d) for n, spec in sorted(OPERATORS.items()) if spec.series} | {"flat": op("ts_cov", x, 2.0, d)}
    for some in (formulas, {k: formulas[k] for k in ("ts_corr", "ts_argmax")}):
        want = {(r.t, r.inst): r for r in evaluate(dense(cells, universe, 60), some).collect()}
        out = evaluate_cells(cells, universe, 60, some)
        rows_out = out.collect()
        got = {(r.t, r.inst): r for r in rows_out}
        assert out.columns == ["t", "inst", *some] and out.schema["t"].dataType.simpleString() == "int"
        assert len(rows_out) == len(got) == 6 * 60 and set(got) == set(want)
        for key, r in got.items():
            for k in some:
                assert same([r[k]], [want[key][k]], 1e-9), (key, k, r[k], want[key][k])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert d == 1 or "explode" not in plan and "Window" not in plan
    mixed = {"v": op("ts_mean", op("divide", x, 2.0), 5), "w": op("ts_mean", op("rank", x), 5), "u": op("delay", x, 2)}
    for k, e in mixed.items():  # missing cells have values, or dates are looked along: these need the dense panel
        want = {(r.t, r.inst): r[k] for r in evaluate(dense(cells, universe, 60), {k: e}).collect()}
        assert {(r.t, r.inst): r[k] for r in evaluate_cells(cells, universe, 60, {k: e}).collect()} == want


def test_instruments_that_lie_across_batches(spark):
    """Batches end within instruments and between them, keys are texts, one instrument has more cells than a batch; and there
    may be no dates at all."""
    from panelspark.plans import evaluate_cells
    from panelspark.sources.panel import dense

    rng = random.Random(5)
    rows = [(t, f"i{i}", rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(40) for t in range(50) if rng.random() < (1.0, 0.1, 0.02)[i % 3]]
    cells, universe = spark.createDataFrame(rows, SCHEMA.replace("inst long", "inst string")), spark.createDataFrame([(f"i{i}",) for i in range(45)], "inst string")
    formulas = {"a": op("ts_corr", data("x"), data("y"), 7), "b": op("ts_argmax", data("x"), 40), "c": op("ts_max", data("x"), 3)}
    want = {(r.t, r.inst): list(r)[2:] for r in evaluate(dense(cells, universe, 50), formulas).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            out = evaluate_cells(cells, universe, 50, formulas).collect()
            assert len(out) == len(want) == 45 * 50 and all(same(list(r)[2:], want[r.t, r.inst], 1e-9) for r in out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert evaluate_cells(cells.limit(0), universe, 0, formulas).collect() == []


def _lines(spark, path, prices):
    rows = [(k, k, k % 7, 1, float(k % 11 + 1), float(p), f"2020-01-{k * k % 28 + 1:02d}") for k, p in enumerate(prices)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, d string")
    lines.withColumn("l_shipdate", F.to_timestamp("d")).drop("d").write.parquet(f"{path}/lineitem.parquet")
    spark.range(1, 9).select(F.col("id").alias("s_suppkey")).write.parquet(f"{path}/supplier.parquet")


@pytest.mark.parametrize("name", ["ts_max_day", "ts_corr_long_day", "ts_rank_day", "ts_argmax_long_day", "ts_mean_long_day", "ts_mean_inf", "ts_max_long_day"])
def test_trailing_daily_queries_shuffle_the_facts_once(spark, tmp_path, name):
    """Facts go to their instrument's task, become cells and are worked off there."""
    from panelspark.queries import QUERIES

    _lines(spark, tmp_path, range(90))
    plan = QUERIES[f"op_{name}"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Exchange hashpartitioning" in line for line in plan) == 2  # facts, universe
    assert not any("FlatMapGroups" in line for line in plan) and not any("decimal(18,2)" in line and "sum(" in line for line in plan)


def test_cents_are_those_of_the_decimal(spark):
    """Near halves of a cent, of both signs, next to the limits, and sums beyond 64 bits."""
    from panelspark.sources.panel import _amount, _cents

    rng = random.Random(3)
    some = [s * (k / 100 + h) for k in (0, 1, 57, 101, 12345, 99999999) for h in (0.0, 0.005, 0.0049999999, 0.0050000001, 0.00499, 0.00501) for s in (1, -1)]
    some += [1.005, 2.675, 1e11, 1e11 - 0.005, 123456789012.345, 9999999999999998.0, -9999999999999998.0, None, 5e-324, 0.0, -0.0] + [rng.uniform(-1e6, 1e6) for _ in range(500)]
    df = spark.createDataFrame([(i % 60, x) for i, x in enumerate(some)] + [(60, 9e15 + i) for i in range(50)] + [(61, None), (62, 9e13), (62, 0.01)], "k int, x double")
    decimal = F.col("x").cast("decimal(18,2)")
    assert df.filter(~_cents(F.col("x")).eqNullSafe((decimal * 100).cast("long"))).collect() == []
    both = df.withColumn("cents", _cents(F.col("x"))).groupBy("k").agg(_amount("cents").alias("a"), F.sum(decimal).cast("double").alias("b"))
    assert both.count() == 63 and both.filter("NOT a <=> b").collect() == []


def calls():
    """One call of every operator."""
    for name, spec in sorted((n, s) for n, s in OPERATORS.items() if n[0] != "_"):
        panels = iter((data("x"), data("y")))
        yield name, op(name, *(next(panels) if k == PANEL else 5 if k == INT else 0.5 for k in spec.kinds))


def table(df, names):
    return {(r.t, r.inst): [r[n] for n in names] for r in df.collect()}


def test_properties_of_all_operators(spark):
    rng = random.Random(1)
    x = {i: [rng.random() for _ in range(24)] for i in range(6)}
    y = {i: [rng.random() for _ in range(24)] for i in range(6)}
    formulas = dict(calls())
    names = list(formulas)
    base = table(evaluate(panel(spark, x, y), formulas), names)
    assert len(base) == 6 * 24  # as many cells as before
    turned = {(i + 2) % 6: v for i, v in x.items()}, {(i + 2) % 6: v for i, v in y.items()}
    moved = table(evaluate(panel(spark, *turned), formulas), names)
    assert all(same(v, moved[t, (i + 2) % 6]) for (t, i), v in base.items())  # instruments have no order
    later = {i: v[:15] + [9.0] * 9 for i, v in x.items()}
    cut = table(evaluate(panel(spark, later, y), formulas), names)
    assert all(same(v, cut[t, i]) for (t, i), v in base.items() if t < 15)  # no look-ahead
    more_x, more_y = x | {i: [None] * 24 for i in (6, 7)}, y | {i: [None] * 24 for i in (6, 7)}
    grown = table(evaluate(panel(spark, more_x, more_y), formulas), names)
    cells = [k for k, n in enumerate(names) if n != "count_valid"]
    assert all(same([v[k] for k in cells], [grown[key][k] for k in cells]) for key, v in base.items())  # empty instruments change nothing


def test_views_are_declared(spark):
    assert {s.sees for s in OPERATORS.values()} == {"cell", "cross", "trail"}
    assert all(s.sees == TRAIL for n, s in OPERATORS.items() if n.startswith("ts_"))
    assert FLOAT in OPERATORS["pow"].kinds
