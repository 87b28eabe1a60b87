import pytest
from pyspark.sql import functions as F

from panelspark.operators import register
from panelspark.operators.registry import CELL, OPERATORS, PANEL
from panelspark.plans import data, evaluate, evaluate_batch, fill, grid, lookback, op, slot

SCHEMA = "t int, inst long, x double, y double, r double"


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame([(t, i, float((t * 7 + i * 3) % 11), float(t + i), 0.01 * ((t + i) % 5 - 2)) for t in range(30) for i in range(5)], SCHEMA)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_canonical_text_and_checks():
    e = op("ts_mean", data("volume"), 10)
    assert e.canonical() == 'ts_mean(data("volume"), 10)' and op("divide", data("volume"), e).canonical() == 'divide(data("volume"), ts_mean(data("volume"), 10))'
    for bad in (lambda: op("ts_mean", data("x")), lambda: op("ts_mean", data("x"), "a"), lambda: op("add", data("x"), "y"), lambda: data(3)):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(KeyError):
        op("nothing", data("x"))


def test_unknown_field(panel):
    with pytest.raises(KeyError):
        evaluate(panel, {"v": data("absent")})


def test_waves_share_exchanges(panel):
    x = data("x")
    many = {f"m{d}": op("ts_mean", x, d) for d in (2, 3, 4)} | {"s": op("ts_stddev", op("ts_mean", x, 3), 4)}
    assert exchanges(evaluate(panel, many)) == 1
    mixed = {"a": op("rank", op("ts_mean", x, 3)), "b": op("cs_zscore", op("delta", x, 1)), "c": op("ts_mean", x, 3)}
    assert exchanges(evaluate(panel, mixed)) == 2
    deep = {"d": op("ts_mean", op("rank", op("delta", x, 1)), 5)}
    assert exchanges(evaluate(panel, deep)) == 3


def test_range_reads_only_its_history(panel):
    e = op("ts_mean", op("delta", data("x"), 2), 3)
    assert lookback(e) == 4 and lookback(op("observed_return", data("x"))) is None
    whole = evaluate(panel, {"v": e}).filter("t >= 20 and t <= 25")
    part = evaluate(panel, {"v": e}, t_from=20, t_to=25)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, part.collect()))
    assert "16" in part._jdf.queryExecution().optimizedPlan().toString()


def test_grid_slot_and_batch(panel):
    variants = grid(lambda d, k: op("pow", op("ts_mean", data("x"), d), k), d=[1, 2], k=[0.5, 2.0])
    assert len(variants) == 4
    filled = list(fill(op("rank", slot()), [data("x"), data("y")], ["add", "flip"]))
    assert len({e.canonical() for e in filled}) == 6 and all("<slot>" not in e.canonical() for e in filled)
    out = evaluate_batch(panel, {"a": data("x"), "b": data("x"), "c": data("y")}, "r")
    assert out.select("expr").distinct().count() == 2 and out.count() == 60
    want = panel.filter("t = 3").agg(F.avg(F.col("x") * F.col("r"))).first()[0]
    assert out.filter("t = 3 and expr = 'data(\"x\")'").first().ret == pytest.approx(want)


def test_own_operator(panel):
    register("double_it", (PANEL,), CELL, lambda a: a * 2)
    try:
        assert evaluate(panel, {"v": op("double_it", data("x"))}).filter("t = 1 and inst = 0").first().v == 14.0
    finally:
        del OPERATORS["double_it"]
