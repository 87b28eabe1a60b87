"""Header-less gzip CSV matrices (a line a date, a column an instrument) and other text files of the signal workflow."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .matrix_source import read_matrices
from .scratch import few, settled

CANDLE = "timestamp timestamp, open double, high double, low double, close double, volume double, source string"


def source_name(file: Column) -> Column:
    """A file's name without its ending; for files in a folder that Spark wrote, the folder's (what follows "=", if any)."""
    last = F.substring_index(F.regexp_replace(file, "/part-[^/]*$", ""), "/", -1)  # first, as a pattern tries every place of a path
    return F.regexp_replace(F.regexp_replace(last, r"(?<=.)(?:\.csv)?(?:\.gz)?$", ""), "^[^=]*=", "")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(t, file, value): the lines of each matrix, numbered in order; ``file`` is the matrix's file, or its folder if it was
    written in parts.

    Files may be split and matrices may be in parts: ids ascend within a block of a file, and blocks are put in order by
    their part's name and by where they start."""
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    blocks = lines.groupBy("part", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    blocks = blocks.withColumn("file", F.regexp_replace("part", "/part-[^/]*$", ""))
    blocks = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("part", "block")) - F.col("n")).drop("n")
    at = (F.col("id") - F.col("first") + F.col("before")).cast("int")
    return lines.join(F.broadcast(blocks), ["part", "block"]).select(at.alias("t"), "file", "value")  # a row a block of a file


def load_matrices(spark: SparkSession, path: str, *, dates: int | None = None, instruments: int | None = None) -> DataFrame:
    """(field, t, inst, value) of the gzip matrices at ``path`` (a file or a pattern); inst is the column's ordinal.

    Cells that are no number are missing.  A matrix whose lines differ in length or whose shape is not
    ``dates`` x ``instruments`` (where given) raises when it is read."""
    lines = _lines(spark, path).withColumn("cells", F.split("value", ",", -1))
    shape = lines.groupBy("file").agg(F.count("*").alias("rows"), F.min(F.size("cells")).alias("least"), F.max(F.size("cells")).alias("most"))
    bad = F.col("least") != F.col("most")
    if dates is not None:
        bad = bad | (F.col("rows") != dates)
    if instruments is not None:
        bad = bad | (F.col("most") != instruments)
    said = F.concat(F.lit("matrix "), F.col("file"), F.lit(" has "), F.col("rows").cast("string"), F.lit(" lines of "), F.col("least").cast("string"), F.lit(" to "), F.col("most").cast("string"), F.lit(" cells"))
    named = source_name(F.col("file")).alias("field")  # once a file: patterns over paths cost more than the cells
    checked = shape.select(F.col("file").alias("f"), named, F.when(bad, F.raise_error(said).cast("boolean")).otherwise(True).alias("good"))
    cells = lines.join(F.broadcast(checked), F.col("file") == F.col("f")).filter("good")  # a row a file
    return cells.select("field", "t", F.posexplode("cells").alias("inst", "cell")).select("field", "t", "inst", F.expr("try_cast(trim(cell) as double)").alias("value")).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def wide(cells: DataFrame, fields: list[str]) -> DataFrame:
    """(t, inst, one column per field)."""
    return cells.groupBy("t", "inst").pivot("field", fields).agg(F.first("value"))


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(remote_path, local_path) of a field catalogue; blanks around names and values go."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.toDF(*(c.strip() for c in rows.columns)).select("remote_path", "local_path")


def load_fields(spark: SparkSession, catalogue: DataFrame, folder: str, calendar: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All dated matrices (first column the date, header the instruments) of a catalogue on (date, inst), and the rejects.

    A file that is missing, cannot be read or has no dated row becomes a row of the rejects (field, reason), and the others
    still load."""
    first, last = calendar.agg(F.min("date"), F.max("date")).first()
    cells = read_matrices(spark, folder).filter(F.col("date").between(F.lit(first), F.lit(last)))  # other lines are not taken apart
    wanted = catalogue.select("local_path", source_name(F.col("remote_path")).alias("field"))
    rows = cells.join(wanted, "field").select(F.col("local_path").alias("field"), "date", "inst", "value")
    kept = rows.join(calendar.select("date"), "date", "left_semi").join(universe.select("inst"), "inst", "left_semi")
    files = read_matrices(spark, folder, cells=False).groupBy("field").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("n"))
    rejects = wanted.join(files, "field", "left").filter("n is null or n = 0 or error like 'cannot%'")  # a part of a matrix may be empty
    return kept, rejects.select(F.col("local_path").alias("field"), F.coalesce("error", F.lit("no file")).alias("reason"))


def matrix_lines(cells: DataFrame, field: str, axis: DataFrame, *, row: str = "t", width: int | None = None) -> DataFrame:
    """(row, line): the field's cells of each row as one line, in the order of ``axis`` (inst, column); missing cells are empty.

    Cells become pieces of text that begin with the commas since the piece before, so that a plan has one expression for all
    columns, whatever their number, and a row's shuffle holds only the cells that are there."""
    width = axis.count() if width is None else width
    once = cells.groupBy(row, "inst").agg(F.first(field).alias("x")).join(few(axis), "inst", "left")
    there = F.when(F.col("x").isNotNull(), F.col("column"))
    earlier = Window.partitionBy(row).orderBy("column").rowsBetween(Window.unboundedPreceding, -1)
    commas = there - F.coalesce(F.last(there, ignorenulls=True).over(earlier), F.lit(0))
    pieces = once.select(row, there.alias("column"), F.concat(F.repeat(F.lit(","), commas), F.col("x").cast("string")).alias("piece"))
    held = pieces.groupBy(row).agg(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("column", "piece"))).alias("held"), F.max("column").alias("last"))
    text = F.array_join(F.transform(F.array_sort("held"), lambda p: p["piece"]), "")
    return held.select(row, F.concat(text, F.repeat(F.lit(","), F.lit(width - 1) - F.coalesce("last", F.lit(0)))).alias("line"))


def save_matrix(panel: DataFrame, field: str, instruments: list | DataFrame, path: str) -> None:
    """The field as header-less gzip CSV, dates in order, one column per instrument; missing cells are empty.

    ``instruments`` is a list in the columns' order, or a table (inst, column) for any number of them.  Ranges of dates are
    parts with names in their order, each a gzip file of its own: tasks write them side by side, readers put them together,
    and so does appending the files, since gzip members may follow each other."""
    if isinstance(instruments, list):
        kind = panel.schema["inst"].dataType.simpleString()
        instruments = panel.sparkSession.createDataFrame([(inst, k) for k, inst in enumerate(instruments)], f"inst {kind}, column int")
    matrix_lines(panel, field, instruments).orderBy("t").select("line").write.option("compression", "gzip").text(path)


#: Dates of a part of a dated matrix.
PART_DATES = 64


def save_dated_matrix(cells: DataFrame, field: str, axis: DataFrame, path: str) -> None:
    """The field of (date, inst, field) as CSV with a header of the instruments of ``axis`` (inst, column) and the date first.

    Runs of dates are parts, and each begins with the header: it sorts before the dates of its run, which stay together."""
    lines = matrix_lines(cells, field, axis, row="date")
    runs = few(settled(lines.select("date").distinct().orderBy("date")).select("date", F.floor(F.row_number().over(Window.orderBy("date")) / F.lit(PART_DATES)).alias("run")))  # dates only
    dated = lines.join(runs, "date").select("run", "date", F.concat_ws(",", F.col("date").cast("string"), "line").alias("line"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("column", F.col("inst").cast("string").alias("inst")))), lambda c: c["inst"])
    head = axis.agg(F.concat(F.lit("date,"), F.array_join(names, ",")).alias("line"))  # one line of the file
    heads = runs.select("run").distinct().crossJoin(F.broadcast(head)).select("run", F.lit(None).cast("date").alias("date"), "line")
    whole = dated.unionByName(heads).repartitionByRange("run").sortWithinPartitions("run", F.col("date").asc_nulls_first())
    whole.select("line").write.text(path)


def save_panel(panel: DataFrame, path: str, date: str = "date") -> None:
    """Parquet, partitioned by year."""
    panel.withColumn("year", F.year(date)).write.partitionBy("year").parquet(path)


#: Folders that the files of instruments are dealt to.
CANDLE_FOLDERS = 256


def _candle_files(path: str, header: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the lines of (folder, inst, line), which come by instrument, to a file each, and gives its number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(path)
        current, out, n = None, None, 0
        try:
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("folder", "inst", "line")))
                for (folder, inst), own in groupby(rows, key=lambda r: r[:2]):
                    if inst != current:
                        if out:
                            out.close()
                        if re.search(r"[^A-Za-z0-9._-]", inst):
                            raise ValueError(f"{inst} is no name for a file")
                        if not n:
                            files.create_dir(f"{base}/{folder}", recursive=True)
                        current, n = inst, n + 1
                        out = files.open_output_stream(f"{base}/{folder}/{inst}.csv", compression=None)
                        out.write(f"{header}\n".encode())
                    out.write("".join(f"{line}\n" for _, _, line in own).encode())
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_pydict({"files": [n]}, schema=pa.schema([("files", pa.int64())]))

    return write


def save_candles(candles: DataFrame, path: str) -> int:
    """(inst, ts, open, high, low, close, volume, source) as a CSV per instrument, in order of time; gives the number of files.

    A task writes the files of its instruments side by side to a folder of its own, under their names: a folder an instrument,
    as a partitioned write makes, would have to be made, moved and listed one by one.  A task that runs again writes the
    same files again."""
    cells = candles.select(F.col("inst").cast("string").alias("inst"), F.col("ts").alias("timestamp"), "open", "high", "low", "close", "volume", "source")
    placed = cells.repartition(CANDLE_FOLDERS, "inst").sortWithinPartitions("inst", "timestamp")
    lines = placed.select(F.spark_partition_id().cast("string").alias("folder"), "inst", F.to_csv(F.struct(*cells.columns[1:])).alias("line"))
    files, base = pyarrow.fs.FileSystem.from_uri(path)
    files.create_dir(base, recursive=True)
    return lines.mapInArrow(_candle_files(path, ",".join(cells.columns[1:])), "files long").agg(F.sum("files")).first()[0]


def load_candles(spark: SparkSession, path: str) -> DataFrame:
    """(inst, ts, open, high, low, close, volume, source) from a CSV per instrument, in folders at ``path`` or where it is a pattern;
    the last record of a time stays."""
    rows = spark.read.schema(CANDLE).option("header", True).option("recursiveFileLookup", True).csv(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    rows = rows.select(*where, "*").withColumn("inst", source_name(F.col("file")))
    last = F.max_by(F.struct("open", "high", "low", "close", "volume", F.coalesce("source", F.lit("")).alias("source")), F.struct("block", "id"))
    return rows.groupBy("inst", F.col("timestamp").alias("ts")).agg(last.alias("c")).select("inst", "ts", "c.*")


def align_candles(candles: DataFrame) -> DataFrame:
    """Every time that any instrument has with every instrument; absent cells are missing."""
    from .panel import reindex

    return reindex(candles, candles, candles, ("ts", "inst"))


def numbered_candles(candles: DataFrame) -> DataFrame:
    """``align_candles`` with the numbers of ``side_tables``: (t, ts, column, inst, ...).

    Instruments have their numbers before missing cells are made, so the dense rows, of which there are times x instruments,
    are joined with the times only."""
    from .panel import dense

    times, ids = (settled(table) for table in side_tables(candles))
    times = few(times)
    cells = candles.join(times, "ts").join(few(ids), "inst").withColumn("inst", F.struct("inst", "column")).drop("ts", "column")
    whole = dense(cells, ids.select(F.struct("inst", "column").alias("inst")), times.count())
    fields = [c for c in candles.columns if c not in ("inst", "ts")]
    return whole.join(times, "t").select("t", "ts", F.col("inst.column").alias("column"), F.col("inst.inst").alias("inst"), *fields)


def side_tables(candles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, ts) and (column, inst), numbered from 0 in order."""
    from .panel import wide_ordinals

    return wide_ordinals(candles, "ts", "t"), wide_ordinals(candles, "inst", "column")


def save_returns(pool: DataFrame, path: str) -> None:
    """A line per expression: the quoted text, then its returns in date order."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("t", "ret"))), lambda x: F.coalesce(x["ret"].cast("string"), F.lit("NaN")))
    quoted = F.concat(F.lit('"'), F.replace(F.col("expr"), F.lit('"'), F.lit('""')), F.lit('"'))
    pool.groupBy("expr").agg(values.alias("v")).select(F.concat_ws(",", quoted, "v").alias("value")).write.text(path)


def load_returns(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(expr, t, ret) of such a file; with ``first``, of its first expressions in order."""
    rows = spark.read.text(path).filter(F.length("value") > 0)
    expr = F.replace(F.regexp_extract("value", '^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))
    rows = rows.select(expr.alias("expr"), F.regexp_replace("value", '^"(?:[^"]|"")*",?', "").alias("rest"))
    if first is not None:
        rows = rows.orderBy("expr").limit(first)
    cells = rows.select("expr", F.posexplode(F.split("rest", ",", -1)).alias("t", "cell"))
    return cells.select("expr", "t", F.expr("try_cast(cell as double)").alias("ret")).withColumn("ret", F.when(~F.isnan("ret"), F.col("ret")))


def load_search_log(spark: SparkSession, path: str) -> DataFrame:
    """(marginal_utility, utility, own_marginal_utility, corr, maxcorr, utility_traj, expr) from a log of tab-separated key: value pairs.

    Lines that start otherwise or that failed to terminate are left out; numbers are absolute values."""
    lines = spark.read.text(path).filter(F.col("value").startswith("marginal_utility") & ~F.contains("value", F.lit("failed to terminate")))
    pairs = lines.select(F.expr(r"str_to_map(value, '\t', ': ')").alias("m"))
    number = lambda key: F.abs(F.try_element_at("m", F.lit(key)).try_cast("double"))
    return pairs.select(
        number("marginal_utility").alias("marginal_utility"), number("_utility").alias("utility"), number("_marginal_utility").alias("own_marginal_utility"), number("corr").alias("corr"), number("maxcorr").alias("maxcorr"),
        F.from_json(F.try_element_at("m", F.lit("utility_traj")), "array<double>").alias("utility_traj"), F.try_element_at("m", F.lit("Expr")).alias("expr"),
    )
