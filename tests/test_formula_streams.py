"""Formulas over streams: equal to batch for every operator after three micro-batches; state of closed dates goes."""

import math
import random
import time

import pytest

from panelspark.operators import OPERATORS
from panelspark.operators.registry import INT, PANEL
from panelspark.plans import data, evaluate, op
from panelspark.streaming.arrays import applied
from panelspark.streaming.formulas import STORE, formula_waves, run_waves, waves

SCHEMA = "t int, inst long, x double, y double"


@pytest.fixture()
def store(spark):
    spark.conf.set(*STORE)
    yield
    spark.conf.unset(STORE[0])


def calls():
    """Every operator with a form over arrays, with windows of several lengths."""
    for name, spec in sorted(OPERATORS.items()):
        if name.startswith("_") or name == "half_range":
            continue
        for d in (-1, 0, 1, 2, 5, 40) if INT in spec.kinds else (5,):
            panels = iter((data("x"), data("y")))
            yield f"{name}_{d}".replace("-", "m"), op(name, *(next(panels) if k == PANEL else d if k == INT else 0.5 for k in spec.kinds))


def cells(seed, dates, instruments):
    rng = random.Random(seed)

    def cell():
        r = rng.random()
        return None if r < 0.15 else math.inf if r < 0.18 else -math.inf if r < 0.2 else 0.0 if r < 0.25 else float(rng.randint(-3, 3)) if r < 0.6 else rng.uniform(-5, 5)

    return [(t, i, cell(), cell()) for t in range(dates) for i in range(instruments)]


def close(a, b):
    return a == b or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(b))


def fed(spark, folder, parts, rows):
    """A stream of files; ``parts(row)`` says in which micro-batch a row comes."""
    for k in sorted({parts(r) for r in rows}):
        spark.createDataFrame([r for r in rows if parts(r) == k], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_every_operator_equals_batch(spark, store, tmp_path):
    rows = cells(3, 60, 4)
    formulas = dict(calls())
    formulas |= {"deep": op("ts_mean", op("rank", op("delta", data("x"), 1)), 5), "mixed": op("add", op("ts_rank", data("x"), 10), op("cs_zscore", op("ts_sum", data("y"), 3))), "field": data("y"), "constant": op("ts_cov", data("x"), 2.0, 4)}
    assert [by_date for by_date, _ in waves(formulas)] == [False, True, False]
    rng = random.Random(1)
    shuffled = rng.sample(rows, len(rows))
    source = fed(spark, str(tmp_path / "in"), lambda r: r[0] // 20, shuffled)
    got = {(r.t, r.inst): r for r in run_waves(spark, source, formulas, str(tmp_path / "out"), instruments=4).collect()}
    want = evaluate(spark.createDataFrame(rows, SCHEMA), formulas).collect()
    assert len(got) == len(want) == 240
    for w in want:
        for name in formulas:
            assert close(got[w.t, w.inst][name], w[name]), (name, w.t, w.inst, got[w.t, w.inst][name], w[name])


def test_streams_go_on_and_state_goes(spark, store, tmp_path):
    """Dates that come in pieces, late and repeated rows; a second run goes on where the first ended."""
    rows = cells(5, 12, 3)
    formulas = {"v": op("rank", op("ts_mean", data("x"), 3))}
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    early = [r for r in rows if r[0] < 6 and not (r[0] > 3 and r[1] == 2)]
    source = fed(spark, folder, lambda r: r[0] // 2, [*early, early[-1]])
    got = run_waves(spark, source, formulas, out, instruments=3, lag=3)
    assert {r.t for r in got.collect()} == {0, 1, 2, 3}
    held = lambda name: sorted(r.key.t for r in spark.read.format("statestore").option("stateVarName", name).load(f"{out}/state-1").select("key").collect())
    assert held("open") == [4, 4, 5, 5]
    fed(spark, folder, lambda r: r[0] // 2 + 9 * (r is rows[0]), [*(r for r in rows if r not in early), rows[0]])  # the last is late
    got = run_waves(spark, source, formulas, out, instruments=3, lag=3)
    found = {(r.t, r.inst): r.v for r in got.collect()}
    assert found == {(r.t, r.inst): r.v for r in evaluate(spark.createDataFrame(rows, SCHEMA), formulas).collect()} and got.count() == 36
    assert held("open") == [] and set(held("closed")) <= {8, 9, 10, 11}  # rows go at once, marks behind the watermark
    fed(spark, folder, lambda r: 0, [(50, 0, 1.0, 1.0)])
    run_waves(spark, source, formulas, out, instruments=3, lag=3)
    assert held("open") == [50] and held("closed") == []


def test_what_cannot_be_kept_up_to_date(spark):
    with pytest.raises(KeyError):
        applied("no_such", [])
    assert len(formula_waves({"a": op("add", data("x"), 1.0)}, instruments=1)) == 1
    spark.conf.unset(STORE[0])
    with pytest.raises(ValueError):
        run_waves(spark, None, {"a": data("x")}, "/tmp", instruments=1)


def test_dates_that_come_whole_are_not_kept():
    """Repeats do not make a date whole, the first of them counts, and a whole date makes no call of the store for a row."""
    import pandas as pd

    from panelspark.streaming.formulas import _ByDate, _Wave

    class Store:
        def __init__(self):
            self.rows, self.calls = {}, 0

        def exists(self):
            return bool(self.rows)

        def containsKey(self, k):
            self.calls += 1
            return k in self.rows

        def updateValue(self, k, v):
            self.calls += 1
            self.rows[k] = v

        def iterator(self):
            return ((k, v) for k, v in self.rows.items())

        def update(self, v):
            self.rows["done"] = v

        def clear(self):
            self.rows.clear()

        def registerTimer(self, at):
            pass

    e = op("rank", data("x"))
    for n in (4, 5):
        made = _ByDate(_Wave({e.canonical(): e}, {data("x").canonical(): "f_x"}, [e.canonical()]), ["w"], ["f_x"], n, 30, "long")
        made.handle, made.open, made.closed = Store(), Store(), Store()
        frames = [pd.DataFrame({"inst": [0, 1, 2], "f_x": [3.0, None, 1.0]}), pd.DataFrame({"inst": [3, 0], "f_x": [2.0, 99.0]})]
        out = list(made.handleInputRows((7,), iter(frames), None))
        if n == 5:
            assert out == [] and made.open.calls > 0 and made.closed.rows == {}
            out = list(made.handleInputRows((7,), iter([pd.DataFrame({"inst": [4], "f_x": [None]})]), None))
        else:
            assert made.open.calls == 0
        got = {r.inst: (r.f_x, r.w) for r in out[0].itertuples()}
        assert got[0] == (3.0, 1.0) and got[2] == (1.0, 0.0) and got[3] == (2.0, 0.5) and got[1] == (None, None) and made.closed.exists()


def test_instruments_share_calls_of_the_store():
    """A bucket of many instruments, some new in a later batch, with late and repeated rows: read and written once a batch."""
    import numpy as np
    import pandas as pd

    from panelspark.streaming.formulas import _ByInstrument, _Wave

    class Store:
        held, calls = None, 0

        def exists(self):
            self.calls += 1
            return self.held is not None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, v):
            self.calls += 1
            self.held = v

    formulas = {"m": op("ts_mean", data("x"), 5), "o": op("observed_return", data("x")), "c": op("ts_cov", data("x"), data("y"), 3)}
    wave = _Wave({e.canonical(): e for e in formulas.values()}, {data(f).canonical(): f"f_{f}" for f in "xy"}, [e.canonical() for e in formulas.values()])
    made = _ByInstrument(wave, list(formulas), ["f_x"], "long")
    made.bucket = Store()
    rows = [(t, i, math.nan if x is None else x, math.nan if y is None else y) for t, i, x, y in cells(9, 30, 50) if t >= 10 or i % 2]
    rng, got = random.Random(2), {}
    for k in range(3):
        part = [r for r in rows if r[0] // 10 == k]
        late = [(0, 1, 5.0, 5.0), (part[0][0], part[0][1], 7.0, 7.0)]  # the second repeats a date of its batch
        shuffled = [*rng.sample(part, len(part)), *late[0 if k else 1 :]]
        frame = pd.DataFrame(shuffled, columns=["t", "inst", "f_x", "f_y"])
        before = made.bucket.calls
        for out in made.handleInputRows((3,), iter([frame[:100], frame[100:]]), None):
            for r in out.astype(object).where(out.notna(), None).to_dict("records"):
                assert (r["t"], r["inst"]) not in got
                got[r["t"], r["inst"]] = r
        assert made.bucket.calls - before <= 3
    assert len(got) == len(rows)
    for i in range(50):
        own = [r for r in rows if r[1] == i]
        found, _ = wave.run({"f_x": np.array([r[2] for r in own]), "f_y": np.array([r[3] for r in own])}, len(own), {})
        for n, r in enumerate(own):
            for name, x in zip(formulas, found.values()):
                assert close(got[r[0], i][name], None if np.isnan(x[n]) else x[n])
    nulls = _ByInstrument(wave, list(formulas), ["f_x"], "long")
    nulls.bucket = Store()
    for t in (1, 2):  # rows without an instrument are one of their own
        (out,) = nulls.handleInputRows((-1,), iter([pd.DataFrame({"t": [t], "inst": [math.nan], "f_x": [2.0 * t], "f_y": [1.0]})]), None)
    assert out["m"].tolist() == [3.0] and nulls.bucket.held[0] == [None]


def test_partitions_of_the_session_stay(spark, store, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        spark.createDataFrame([(0, None, 1.0, 1.0), (0, 5, 3.0, 1.0)], SCHEMA).write.parquet(str(tmp_path / "in"))
        out = run_waves(spark, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), {"v": op("ts_sum", data("x"), 2)}, str(tmp_path / "out"), instruments=2)
        assert sorted(map(tuple, out.collect()), key=str) == [(0, 5, 3.0), (0, None, 1.0)]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
        assert spark.read.format("state-metadata").load(str(tmp_path / "out" / "state-0")).first().numPartitions == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
