"""Small helpers that several corpus operators use."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only on one machine, where it is unset (tests), a local one."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path:
        return path
    if not context.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, with their lineage cut, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


#: Key tables of at most so many rows (16 bytes each) may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000


def small(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """``keys``, marked for broadcast if a count shows that they are few."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def spread_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` of the rows (all, if they are fewer), the same on every run: those whose key's hash is low.

    Only the sample moves; there is no global sort and no list of candidates from every task."""
    total = rows.count()
    if total <= size:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(23)), F.lit(1 << 40)) < int(size / total * (1 << 40)))


def ended(batches: Iterator, *release: Callable[[], None]) -> Iterator:
    """The batches of a task; when they end, what the task held is released, so that reused workers stay small."""
    try:
        yield from batches
    finally:
        for f in release:
            f()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns, name: str) -> str:
    """A column name like ``name`` that ``columns`` (case-insensitively) do not hold."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_fold(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id's decimal text leaves this remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder
