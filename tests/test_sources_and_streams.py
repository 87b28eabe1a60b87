import datetime
import gzip
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from panelspark.operators import pool as P
from panelspark.plans import data, evaluate, op
from panelspark.sources import matrices as M
from panelspark.sources.panel import adv, dense, mask_universe, reindex, with_returns
from panelspark.streaming import bars, trailing_stream


def test_matrices(spark, tmp_path):
    for name, text in {"close": "1,2\n,x\n5,NaN\n", "open": "7,8\n9,10\n11,12\n"}.items():
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(text)
    cells = M.load_matrices(spark, str(tmp_path / "*.csv.gz"), dates=3, instruments=2)
    got = {(r.field, r.t, r.inst): r.value for r in cells.collect()}
    assert got["close", 0, 1] == 2.0 and got["close", 1, 0] is None and got["close", 1, 1] is None and got["close", 2, 1] is None and got["open", 2, 0] == 11.0
    panel = M.wide(cells, ["close", "open"])
    assert panel.count() == 6 and panel.columns == ["t", "inst", "close", "open"]
    M.save_matrix(panel, "open", [0, 1], str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["7.0,8.0", "9.0,10.0", "11.0,12.0"]
    with gzip.open(tmp_path / "bad.csv.gz", "wt") as f:
        f.write("1,2\n3\n")
    with pytest.raises(Exception, match="bad.csv.gz"):
        M.load_matrices(spark, str(tmp_path / "bad.csv.gz")).collect()


def test_plain_matrices_may_be_split(spark, tmp_path):
    rows = [",".join(str(t * 10 + k) for k in range(5)) for t in range(3000)]
    (tmp_path / "wide.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "f.csv").write_text("date,A,B\n" + "".join(f"2020-01-{1 + t % 28:02d},{t},{t + 1}\n" for t in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        cells = M.load_matrices(spark, str(tmp_path / "wide.csv"), dates=3000, instruments=5)
        assert cells.select("t").distinct().count() == 3000 and cells.filter("value <> t * 10 + inst").count() == 0
        cat = spark.createDataFrame([("f.csv", "f")], "remote_path string, local_path string")
        days = spark.createDataFrame([(f"2020-01-{d:02d}",) for d in range(1, 29)], "d string").select(F.to_date("d").alias("date"))
        got, rejects = M.load_fields(spark, cat, str(tmp_path / "raw"), days, spark.createDataFrame([("A",), ("B",)], "inst string"))
        assert got.count() == 6000 and rejects.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_wide_matrices_have_small_plans(spark, tmp_path):
    """Gaps at both ends and in the middle, an empty line, instruments out of the list; the plan does not grow with the columns."""
    cells = spark.createDataFrame([(0, 2, 1.5), (0, 4, 2.0), (1, 0, None), (2, 5, -3.0), (2, 0, 7.0), (3, 99, 1.0)], "t int, inst long, x double")
    M.save_matrix(cells, "x", list(range(6)), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == [",,1.5,,2.0,", ",,,,,", "7.0,,,,,-3.0", ",,,,,"]
    plans = []
    for n in (10, 20000):
        axis = spark.range(n).select(F.col("id").alias("inst"), F.col("id").cast("int").alias("column"))
        lines = M.matrix_lines(spark.range(n).select(F.lit(0).alias("t"), F.col("id").alias("inst"), F.lit(1.0).alias("x")), "x", axis)
        plans.append(len(lines._jdf.queryExecution().optimizedPlan().toString()))
        assert lines.first().line == ",".join(["1.0"] * n)
    assert plans[1] < plans[0] + 100


def test_catalogue_and_rejects(spark, tmp_path):
    (tmp_path / "cat.csv").write_text("remote_path, local_path\nd/close_x.csv, close\nd/gone.csv, gone\n")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "close_x.csv").write_text("date,A,B\n2020-01-01,1,2\n2020-01-02,3,\n2020-01-09,9,9\n")
    cat = M.load_catalogue(spark, str(tmp_path / "cat.csv"))
    calendar = spark.createDataFrame([("2020-01-01",), ("2020-01-02",)], "d string").select(F.to_date("d").alias("date"))
    universe = spark.createDataFrame([("A",), ("B",)], "inst string")
    rows, rejects = M.load_fields(spark, cat, str(tmp_path / "raw"), calendar, universe)
    assert rows.count() == 4 and rows.filter("value is null").count() == 1 and [r.field for r in rejects.collect()] == ["gone"]


def test_dated_matrices_in_parts(spark, tmp_path, monkeypatch):
    """Every part begins with the header, and a file whose dates are all outside of the calendar is no reject."""
    monkeypatch.setattr(M, "PART_DATES", 3)
    cells = spark.range(40).select(F.expr("date_add(date'2020-01-01', cast(id div 4 as int))").alias("date"), (F.col("id") % 5).alias("inst"), F.col("id").cast("double").alias("x"))
    axis = spark.range(5).select(F.col("id").alias("inst"), F.col("id").cast("int").alias("column"))
    M.save_dated_matrix(cells, "x", axis, str(tmp_path / "raw" / "x.csv"))
    parts = [p.read_text().splitlines() for p in (tmp_path / "raw" / "x.csv").glob("part-*") if p.stat().st_size]
    assert parts and all(p[0] == "date,0,1,2,3,4" for p in parts) and sorted(x for p in parts for x in p if x[0] == "2")[0] == "2020-01-01,0.0,1.0,2.0,3.0,"
    (tmp_path / "raw" / "old.csv").write_text("date,0\n1999-01-01,1\n")
    cat = spark.createDataFrame([("x.csv", "x"), ("old.csv", "old"), ("gone.csv", "gone")], "remote_path string, local_path string")
    days, held = cells.select("date").distinct(), axis.select(F.col("inst").cast("string").alias("inst"))
    got, rejects = M.load_fields(spark, cat, str(tmp_path / "raw"), days, held)
    want = {(r.date, str(r.inst)): r.x for r in cells.collect()}
    assert {(r.date, r.inst): r.value for r in got.collect() if r.value is not None} == want and got.count() == 50 and [r.field for r in rejects.collect()] == ["gone"]


def test_matrix_source(spark, tmp_path):
    """Files that are damaged, cut off, empty or of several gzip members; conditions narrow what is read and change nothing."""
    from panelspark.sources.matrix_source import read_matrices

    text = "date, A,B ,C\n" + "".join(f"2020-01-{d:02d},{d},x,{'' if d % 2 else d * 2}\r\n" for d in range(1, 29))
    lines = text.encode().splitlines(keepends=True)
    whole = gzip.compress(text.encode())
    for name, content in {"a.csv": text.encode(), "b.csv.gz": b"".join(gzip.compress(x) for x in lines), "cut.csv.gz": whole[:-12], "bad.csv.gz": whole[:40] + b"\xff" * 30 + whole[70:], "empty.csv": b"", "undated.csv": b"x,y\n1,2\n", "_hidden": b"?", "c.csv": text.encode().rstrip()}.items():
        (tmp_path / name).write_bytes(content)
    rows = read_matrices(spark, str(tmp_path), split_bytes=100).collect()
    assert {r.field for r in rows if r.error and r.error.startswith("cannot be read")} == {"cut", "bad"}
    assert {r.field for r in rows if r.error == "no dated rows"} == {"empty", "undated"} and sum(r.error is not None for r in rows) == 4
    for field in "abc":
        own = {(r.date.day, r.inst): r.value for r in rows if r.field == field}
        assert own == {(d, i): {"A": float(d), "B": None, "C": None if d % 2 else d * 2.0}[i] for d in range(1, 29) for i in "ABC"}
    plain = spark.createDataFrame(rows, "field string, date date, inst string, value double, error string")
    for condition in ("field = 'a' and inst in ('A', 'C')", "date >= '2020-01-20' and date < '2020-01-22'", "inst = 'B' or inst is null", "date = '2020-01-03' and field in ('b', 'cut', null)", "error is not null", "inst in (null)", "date > '2020-01-27' and inst = 'A'"):
        key = lambda df: sorted(map(repr, (tuple(r) for r in df.filter(condition).collect())))
        assert key(read_matrices(spark, str(tmp_path))) == key(plain), condition


def test_wide_ordinals(spark):
    from panelspark.sources.panel import ordinals, wide_ordinals

    rows = spark.createDataFrame([((k * 7919) % 503,) for k in range(2000)] + [(None,)], "k long").repartition(7)
    assert sorted(map(tuple, wide_ordinals(rows, "k", "n").collect())) == sorted(map(tuple, ordinals(rows, "k", "n").collect()))
    assert "SinglePartition" not in wide_ordinals(rows, "k", "n")._jdf.queryExecution().executedPlan().toString()
    assert wide_ordinals(rows.limit(0), "k", "n").isEmpty()


def test_returns_file_round_trip(spark, tmp_path):
    pool = spark.createDataFrame([('f("a", 1)', 0, 0.5), ('f("a", 1)', 1, None), ("g", 0, 1.0), ("g", 1, -2.0)], "expr string, t int, ret double")
    M.save_returns(pool, str(tmp_path / "r"))
    assert sorted(map(tuple, M.load_returns(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, pool.collect()), key=lambda r: r[:2])
    assert M.load_returns(spark, str(tmp_path / "r"), first=1).select("expr").distinct().count() == 1


def test_search_log(spark, tmp_path):
    with gzip.open(tmp_path / "log.gz", "wt") as f:
        f.write("noise\nmarginal_utility: -0.5\t_utility: 0.2\tcorr: -0.1\tmaxcorr: 0.3\t_marginal_utility: -0.4\tutility_traj: [1.0, 2.5]\tExpr: add(a, b)\nmarginal_utility: failed to terminate\n")
    (row,) = M.load_search_log(spark, str(tmp_path / "log.gz")).collect()
    assert (row.marginal_utility, row.utility, row.corr, row.utility_traj, row.expr) == (0.5, 0.2, 0.1, [1.0, 2.5], "add(a, b)") and row.own_marginal_utility == 0.4


def test_candles(spark, tmp_path):
    for name, text in {"AA": "2024-01-01T00:00:00Z,1,2,0.5,1.5,10,\n2024-01-01T00:00:00Z,1,3,0.5,2.5,20,x\n", "BB": "2024-01-01T01:00:00Z,5,6,4,5,7,\n"}.items():
        (tmp_path / f"{name}.csv").write_text("timestamp,open,high,low,close,volume,source\n" + text)
    c = M.load_candles(spark, str(tmp_path / "*.csv"))
    assert c.count() == 2 and c.filter("inst = 'AA'").first().volume == 20.0
    assert M.align_candles(c).count() == 4
    times, ids = M.side_tables(c)
    assert [r.t for r in times.orderBy("ts").collect()] == [0, 1] and [r.inst for r in ids.orderBy("column").collect()] == ["AA", "BB"]


def test_candle_files_lie_side_by_side(spark, tmp_path):
    """A file an instrument with what was to be written, without a folder each; aligned and numbered as by the single steps."""
    rows = [(f"u{i}", datetime.datetime(2024, 1, 1, h), float(i), 9.0, 0.5, None if h == 3 else i + h / 10, 1e-7 * h, "a,b" if h == 2 else "") for i in range(300) for h in range(5) if (i + h) % 3]
    candles = spark.createDataFrame(rows, "inst string, ts timestamp, open double, high double, low double, close double, volume double, source string")
    path = str(tmp_path / "candles")
    assert M.save_candles(candles, path) == 300
    folders = [d for d in os.listdir(path) if os.path.isdir(f"{path}/{d}")]
    names = [f for d in folders for f in os.listdir(f"{path}/{d}")]
    assert len(folders) <= M.CANDLE_FOLDERS < 300 and sorted(names) == sorted(f"u{i}.csv" for i in range(300))
    text = next(open(f"{path}/{d}/u4.csv").read() for d in folders if os.path.exists(f"{path}/{d}/u4.csv")).splitlines()
    assert text[0] == "timestamp,open,high,low,close,volume,source" and len(text) == 5
    read = M.load_candles(spark, path).cache()
    assert sorted(map(tuple, read.collect())) == sorted(rows)
    times, ids = M.side_tables(read)
    want = M.align_candles(read).join(times, "ts").join(ids, "inst")
    columns = ["t", "ts", "column", "inst", "open", "close", "source"]
    got = M.numbered_candles(read)
    assert got.columns == ["t", "ts", "column", "inst", "open", "high", "low", "close", "volume", "source"] and got.count() == 1500
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
    assert M.save_candles(candles.limit(0), str(tmp_path / "none")) in (0, None) and M.load_candles(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no name for a file"):
        M.save_candles(candles.limit(1).withColumn("inst", F.lit("a/b")), str(tmp_path / "bad"))


def test_names_of_files_are_cheap(spark):
    """The time does not grow with the square of a path's length."""
    names = {"file:/a/b/AA.csv": "AA", "/a/b.csv.gz": "b", "/x/inst=u7/part-0-1.csv": "u7", "/x/close.csv.gz/part-00001.csv.gz": "close", "a.csv.csv": "a.csv", "/d/.csv": ".csv", "/d/x.gz": "x", "/d/": ""}
    rows = spark.createDataFrame([(k,) for k in names], "file string")
    assert {r.file: r.name for r in rows.select("file", M.source_name(F.col("file")).alias("name")).collect()} == names
    start = time.time()
    long = spark.range(40).select(M.source_name(F.concat(F.repeat(F.lit("d"), F.lit(60000)), F.lit("/"), F.col("id").cast("string"), F.lit("/AA.csv"))).alias("name"))
    assert long.filter("name = 'AA'").count() == 40 and time.time() - start < 20


def test_panel_helpers(spark):
    obs = spark.createDataFrame([(0, "a", 1.0), (9, "a", 2.0), (1, "zz", 3.0)], "t int, inst string, volume double")
    cal, uni = spark.createDataFrame([(0,), (1,)], "t int"), spark.createDataFrame([("a",), ("b",)], "inst string")
    assert sorted(map(tuple, reindex(obs, cal, uni).collect()), key=str) == sorted([(0, "a", 1.0), (0, "b", None), (1, "a", None), (1, "b", None)], key=str)
    p = spark.createDataFrame([(t, "a", float(t) if t % 2 == 0 else None) for t in range(8)], "t int, inst string, volume double")
    got = {r.t: r.adv20 for r in adv(p, n=2).collect()}
    assert got == {0: None, 1: None, 2: 1.0, 3: None, 4: 3.0, 5: None, 6: 5.0, 7: None}
    member = spark.createDataFrame([(2, "a")], "t int, inst string")
    assert {r.t: r.volume for r in mask_universe(p, member, ["volume"]).collect() if r.volume is not None} == {2: 2.0}
    r = with_returns(spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (2, "a", 3.0)], "t int, inst string, close double")).orderBy("t").collect()
    assert [x["returns"] for x in r] == [None, 1.0, 0.5] and [x.returns_d1 for x in r] == [1.0, 0.5, None]


def test_dense_panels_shuffle_cells_only(spark):
    """Repeated cells stay, gaps at both ends are filled, instruments without cells or without a key have a row a date, and
    windows along instruments need no further exchange."""
    obs = spark.createDataFrame([(2, "a", 1.0), (2, "a", 2.0), (5, "a", 3.0), (7, "a", 9.0), (0, "zz", 3.0), (None, "a", 4.0), (2, None, 5.0)], "t int, inst string, x double")
    cal, uni = spark.createDataFrame([(5,), (2,), (0,), (9,), (2,)], "t int"), spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "inst string")
    grid = cal.distinct().crossJoin(uni.distinct())
    got = reindex(obs, cal, uni)
    assert got.columns == ["t", "inst", "x"] and sorted(map(str, got.collect())) == sorted(map(str, grid.join(obs, ["t", "inst"], "left").collect()))
    panel = dense(spark.range(50).select(F.col("id").cast("int").alias("t"), (F.col("id") % 3).alias("inst"), F.rand(1).alias("x")), spark.range(4).select(F.col("id").alias("inst")), 60)
    mean = evaluate(panel, {"v": op("ts_mean", data("x"), 3)})
    assert mean.count() == 240 and mean._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(inst") == 1


def test_long_short(spark):
    rows = [(0, 1, 1.0, 10.0), (0, 2, -1.0, 20.0), (1, 1, 1.0, 11.0), (1, 2, -1.0, 19.0)]
    df = spark.createDataFrame(rows, "t int, inst int, pos double, price double")
    out = {r.t: r for r in P.long_short_returns(df, "pos", "price", book=1000.0).collect()}
    assert out[0].turnover == 2.0 and out[0].pnl == pytest.approx(100 + 50 - 0.0005 * 2000) and out[0].log_return == pytest.approx(math.log1p(out[0].pnl / 2000))
    assert out[0].position == 2000.0 and out[1].pnl is None and out[1].log_return is None


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.createDataFrame([(i % 2, f"2024-01-01 0{i // 12}:{i % 12 * 5:02d}:00", float(i)) for i in range(48)], "inst int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    q = bars(stream, late="1 hour").writeStream.outputMode("complete").format("memory").queryName("bars_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, bars(ticks).collect()))

    rows = spark.createDataFrame([(t, i, float((t * 5 + i) % 7)) for t in range(12) for i in range(3)], "t int, inst long, value double")
    for k in range(3):
        rows.filter(F.floor(F.col("t") / 4) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "rows"))
    q = trailing_stream(stream, lambda w: float(w[-3:].mean()), lookback=2).writeStream.outputMode("append").format("memory").queryName("trail_out").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = evaluate(rows, {"v": op("ts_mean", data("value"), 3)})
    got = {(r.t, r.inst): r.signal for r in spark.table("trail_out").collect()}
    assert got == pytest.approx({(r.t, r.inst): r.v for r in want.collect()})
