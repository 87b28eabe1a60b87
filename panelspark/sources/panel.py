"""Dense panels keyed by (t, inst) on a calendar and a universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ieee_div, nz
from .scratch import few, settled


def dense(cells: DataFrame, universe: DataFrame, n: int, t: str = "t", inst: str = "inst") -> DataFrame:
    """Every ordinal 0 ... n - 1 with every instrument of the universe; ordinals without cells are missing, cells of other
    instruments go.

    Only the cells are shuffled, by instrument: each makes the missing rows up to the next one where it is, so that what
    looks along instruments next needs no exchange."""
    fields = [c for c in cells.columns if c not in (t, inst)]
    at, following, start = "__at", "__next", "__start"
    starts = universe.select(inst).distinct().withColumn(t, F.lit(-1))
    held = cells.filter(F.col(inst).isNotNull()).withColumn(t, F.col(t).cast("int"))
    rows = starts.unionByName(held, allowMissingColumns=True)
    w = Window.partitionBy(inst).orderBy(t)
    rows = rows.withColumns({following: F.lead(t).over(w), start: F.first(t).over(w)}).filter(F.col(start) == -1)
    first, last = F.greatest(F.col(t), F.lit(0)), F.greatest(F.coalesce(following, F.lit(n)) - 1, F.col(t))
    rows = rows.withColumn(at, F.explode(F.when(first <= last, F.sequence(first, last))))
    return rows.select(F.col(at).alias(t), inst, *(F.when(F.col(at) == F.col(t), F.col(c)).alias(c) for c in fields))


def reindex(observed: DataFrame, calendar: DataFrame, universe: DataFrame, keys: tuple[str, str] = ("t", "inst")) -> DataFrame:
    """Every date of the calendar with every instrument of the universe; cells without rows are missing, rows of
    other dates or instruments go.  The panel is dates x instruments by definition; both lists are its axes."""
    date, inst = keys
    days = few(settled(wide_ordinals(calendar, date, "__day")))
    placed = observed.join(days, date).drop(date)
    whole = dense(placed, universe, days.count(), "__day", inst).join(days, "__day")
    return whole.select(date, inst, *(c for c in observed.columns if c not in keys))


def members_only(rows: DataFrame, universe: DataFrame, key: str = "inst") -> DataFrame:
    return rows.join(universe.select(key), key, "left_semi")


def mask_universe(panel: DataFrame, membership: DataFrame, fields: list[str]) -> DataFrame:
    """Fields become missing where (t, inst) is not in ``membership``."""
    marked = panel.join(membership.select("t", "inst").distinct().withColumn("__in", F.lit(True)), ["t", "inst"], "left")
    return marked.select(*(F.when(F.col("__in"), F.col(c)).alias(c) if c in fields else F.col(c) for c in panel.columns))


def ordinals(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(name, key): distinct keys numbered from 0 in order.  Only an axis of the panel passes through one task; for keys
    without such a bound there is ``wide_ordinals``."""
    distinct = rows.select(key).distinct()
    return distinct.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1).cast("int").alias(name), key)


def wide_ordinals(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The same numbers for any number of keys: ranges of them are sorted side by side and written, and each is numbered
    from what the ranges before it hold."""
    ordered = settled(rows.select(F.col(key).alias("key")).distinct().orderBy("key"))
    placed = ordered.select("key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    before, total = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):  # a row a range
        before.append((r["part"], total))
        total += r["count"]
    held = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))
    return placed.join(held, "part").select((F.col("at") + F.col("before")).cast("int").alias(name), F.col("key").alias(key))


def with_returns(panel: DataFrame, close: str = "close") -> DataFrame:
    """``returns`` (on the row before) and ``returns_d1`` (the next row's) from ``close``."""
    w = Window.partitionBy("inst").orderBy("t")
    before = F.lag(close, 1).over(w)
    out = panel.withColumn("returns", nz(ieee_div(F.col(close) - before, before)))
    return out.withColumn("returns_d1", F.lead("returns", 1).over(w))


def adv(panel: DataFrame, volume: str = "volume", n: int = 20, name: str = "adv20") -> DataFrame:
    """``name``: mean of the last n observed volumes; missing until n are seen and where there is none.

    Rows with and without a volume are windows of their own, so the last n rows of a window are the last n observed."""
    w = Window.partitionBy("inst", F.col(volume).isNull()).orderBy("t").rowsBetween(-(n - 1), 0)
    return panel.withColumn(name, F.when(F.count(volume).over(w) == n, F.avg(volume).over(w)))


#: Rows of a fact table that a task makes cells of, so that its tables stay small however large the input is.
TASK_ROWS = 500_000


def _cents(price: Column) -> Column:
    """What ``cast(price AS decimal(18,2))`` counts in hundredths; the cast itself, which writes the number out, only near
    halves and for large prices."""
    near = price * 100
    plain = (F.abs(price) < 1e11) & (F.abs(near - F.rint(near)) < 0.49)
    return F.when(plain, F.rint(near).cast("long")).otherwise((price.cast("decimal(18,2)") * 100).cast("long"))


def _amount(cents: str) -> Column:
    """The double next to the exact sum of these hundredths, added up in two parts so that none overflows."""
    high, low = F.sum(F.expr(f"{cents} div 1000000000")), F.sum(F.col(cents) % 1_000_000_000)
    exact = high.cast("decimal(19,0)") * F.expr("10000000BD") + low.cast("decimal(19,0)") * F.expr("0.01BD")
    return F.when((high == 0) & (F.abs(low) < 1 << 53), low / 100.0).otherwise(exact.cast("double"))


def _lineitem_cells(spark: SparkSession, sf_dir: str, t: Column, by_inst: bool = False) -> DataFrame:
    """With ``by_inst`` rows go to their instrument's task before they become cells, and what looks along instruments next
    needs no exchange: for cells of so few rows each that adding up before the exchange would save none of it."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"t": t, "inst": F.col("l_suppkey")})
    if by_inst:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))  # fewer would be dealt out anew by the join that follows
        rows = rows.repartition(max(least, rows.count() // TASK_ROWS), "inst")
    price = F.col("l_extendedprice")
    cells = rows.withColumn("cents", _cents(price)).groupBy("t", "inst").agg(
        F.sum("l_quantity").alias("volume"),
        _amount("cents").alias("amount"),
        F.max(price).alias("high"), F.min(price).alias("low"),
        F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", price.alias("p"))).alias("first"),
    )
    return cells.select("t", "inst", "volume", (F.col("amount") / F.col("volume")).alias("close"), F.col("first.p").alias("open"), "high", "low")


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("inst"))


def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months x suppliers from ``lineitem``; t counts months from January 1995."""
    day = F.col("l_shipdate")
    t = ((F.year(day) - 1995) * 12 + F.month(day) - 1).cast("int")
    months = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(t.alias("t"))
    return reindex(_lineitem_cells(spark, sf_dir, t), months, _universe(spark, sf_dir))


def day_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """The cells that ``day_panel`` has rows for, its universe and its number of days."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("date"))
    days = settled(ordinals(rows, "date", "t"))
    cells = _lineitem_cells(spark, sf_dir, F.to_date("l_shipdate"), by_inst=True).withColumnRenamed("t", "date").join(few(days), "date").drop("date")
    return cells, _universe(spark, sf_dir), days.count()


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping days x suppliers from ``lineitem``; t is the day's ordinal among all that occur."""
    return dense(*day_cells(spark, sf_dir))
