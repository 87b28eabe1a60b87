"""Analytics over search results: sequences, logs, weights tables, trajectories, text complexity."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import cycle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import few, settled


def transitions(sequences: DataFrame, *, seq: str = "seq_id", step: str = "step", token: str = "token", start: str = "0") -> DataFrame:
    """(prev, next, n, p): counts of successors, and their share among all successors of ``prev``."""
    before = F.lag(token, 1, start).over(Window.partitionBy(seq).orderBy(step))
    counts = sequences.select(before.alias("prev"), F.col(token).alias("next")).groupBy("prev", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def frequent_transitions(table: DataFrame, least: float = 0.005) -> DataFrame:
    return table.filter(F.col("p") > least)


def sequence_features(sequences: DataFrame, *, seq: str = "seq_id", token: str = "token", data_tokens: list[str], op_tokens: list[str], done: str, scale: float = 30.0) -> DataFrame:
    """Per sequence: scaled length, data and operator counts, entropy of its tokens in nats, and whether it is done."""
    counts = sequences.groupBy(seq, token).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(seq))
    counts = counts.withColumn("p", F.col("n") / total)
    of = lambda tokens: F.sum(F.when(F.col(token).isin(tokens), F.col("n")).otherwise(0)) / scale
    return counts.groupBy(seq).agg(
        (F.sum("n") / scale).alias("length"), of(data_tokens).alias("n_data"), of(op_tokens).alias("n_ops"),
        F.sum(-F.col("p") * F.log("p")).alias("entropy"), F.max((F.col(token) == done).cast("int")).alias("done"),
    )


def batch_summary(episodes: DataFrame, *, batch: str = "iteration", reward: str = "reward", length: str = "length") -> DataFrame:
    """Per batch: mean and population deviation of the reward, mean length, and how many rewards are there."""
    return episodes.groupBy(batch).agg(F.avg(reward).alias("mean_reward"), F.stddev_pop(reward).alias("std_reward"), F.avg(length).alias("mean_length"), F.count(reward).alias("n_valid"))


def quantile_by_bucket(rows: DataFrame, bucket: Column, value: str, q: float, *, exact: bool = True, bins: int = 1024, enough: int = 10_000) -> DataFrame:
    """(bucket, q): the value's quantile in each bucket, interpolated; approximate where ``exact`` is not asked for.

    The exact form brings no bucket into one task: rounds of partial counts over ``bins`` parts of a bucket's range find the
    part that holds the wanted place, and only its rows go on, until they are ``enough`` or fewer or all equal.  The parts
    are equal in logarithms and in values by turns, so that neither long tails nor narrow clusters need many rounds.
    Missing values and NaN are left out; buckets without values have a missing quantile."""
    x = rows.select(bucket.alias("bucket"), F.col(value).cast("double").alias("v"))
    if not exact:
        return x.groupBy("bucket").agg(F.percentile_approx(F.when(~F.isnan("v"), F.col("v")), q, 10_000).alias("q"))
    x = settled(x)
    every, x = x.select("bucket").distinct(), x.filter("v is not null and not isnan(v)")
    finite = F.when(F.abs("v") != float("inf"), F.col("v"))
    span = [F.min("v").alias("lo"), F.max("v").alias("hi"), F.min(finite).alias("from"), F.max(finite).alias("to"), F.min(F.when(F.col("v") != 0, F.abs(finite))).alias("least")]
    by_size = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(F.col(c))) - F.log("least") + 1))
    by_value = lambda c: F.col(c) / 2  # noqa: E731  half, so that no width overflows
    at = (F.col("n") - 1) * q
    # of a bucket (``of``) the values from lo to hi, n of them, hold the wanted place k and, a share ``part`` on, the next
    open_ = x.groupBy("bucket").agg(F.count("*").alias("n"), *span).select(F.col("bucket").alias("of"), "n", F.floor(at).alias("k"), (at - F.floor(at)).alias("part"), "lo", "hi", "from", "to", "least")
    found = []
    for scale in cycle((by_size, by_value)):
        open_ = settled(open_)
        inside = lambda state: x.join(few(state), F.col("bucket").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        last = inside(open_.filter(F.col("n") <= enough)).groupBy("of", "k", "part").agg(F.array_sort(F.collect_list("v")).alias("a"))
        found.append(last.select("of", "part", F.element_at("a", (F.col("k") + 1).cast("int")).alias("v1"), F.try_element_at("a", (F.col("k") + 2).cast("int")).alias("v2")))
        wide = open_.filter(F.col("n") > enough)
        if wide.isEmpty():
            break
        share = F.coalesce(F.try_divide(scale("v") - scale("from"), scale("to") - scale("from")), F.lit(0.0))
        piece = F.least(F.floor(share * bins), F.lit(bins - 1))
        piece = F.when(F.col("v") == float("-inf"), -1).when(F.col("v") == float("inf"), bins).otherwise(piece)
        parts = inside(wide).groupBy("of", "k", "part", piece.alias("piece")).agg(F.count("*").alias("n"), *span)
        order = Window.partitionBy("of").orderBy("piece")  # as many rows as there are pieces
        parts = parts.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("next", F.lead("lo").over(order))
        hit = settled(parts.filter("before <= k and k < before + n").withColumn("k", F.col("k") - F.col("before")))
        both = (F.col("part") == 0) | (F.col("k") + 1 < F.col("n"))
        done = ~both | (F.col("lo") == F.col("hi"))
        found.append(hit.filter(done).select("of", "part", F.col("hi").alias("v1"), F.when(both, F.col("hi")).otherwise(F.col("next")).alias("v2")))
        open_ = hit.filter(~done).select("of", "n", "k", "part", "lo", "hi", "from", "to", "least")
    values = reduce(DataFrame.unionByName, found)
    value = F.when((F.col("part") == 0) | (F.col("v1") == F.col("v2")), F.col("v1")).otherwise((1 - F.col("part")) * F.col("v1") + F.col("part") * F.col("v2"))
    return every.join(few(values.select("of", value.alias("q"))), F.col("bucket").eqNullSafe(F.col("of")), "left").select("bucket", "q")


def weighted_portfolios(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """From returns (t, inst, ret) and weights (pid, inst, w), per portfolio: arithmetic and geometric mean, sample
    deviation, drag = geometric - arithmetic, and half the variance.  Dates with a missing return are left out."""
    whole = returns.groupBy("t").agg(F.count_if(F.col("ret").isNull()).alias("lost")).filter("lost = 0").select("t")
    daily = returns.join(whole, "t", "left_semi").join(weights, "inst").groupBy("pid", "t").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
    out = daily.groupBy("pid").agg(F.avg("r").alias("arith"), (F.exp(F.avg(F.log1p("r"))) - 1).alias("geo"), F.stddev_samp("r").alias("std"))
    return out.withColumn("drag", F.col("geo") - F.col("arith")).withColumn("half_var", F.col("std") * F.col("std") / 2)


def trajectory_steps(rows: DataFrame, *, key: str, values: str, first: int = 20) -> DataFrame:
    """(key, step, diff): first differences of the first ``first`` values of arrays that have so many."""
    long = rows.filter(F.size(values) >= first).select(key, F.posexplode(F.slice(values, 1, first)).alias("step", "v"))
    before = F.lag("v").over(Window.partitionBy(key).orderBy("step"))
    return long.select(key, "step", (F.col("v") - before).alias("diff")).filter("step > 0")


def trajectory_summary(steps: DataFrame, *, key: str) -> tuple[DataFrame, DataFrame]:
    """Mean difference per step and per trajectory."""
    return steps.groupBy("step").agg(F.avg("diff").alias("mean_diff")), steps.groupBy(key).agg(F.avg("diff").alias("mean_diff"))


def trajectory_medians(steps: DataFrame, *, key: str) -> DataFrame:
    """One row (time_median, ensemble_median): the medians of the steps' and of the trajectories' mean differences.  A
    trajectory with a missing step has no mean."""
    by_step, by_key = trajectory_summary(steps, key=key)
    median = lambda means, name: quantile_by_bucket(means, F.lit(0), "mean_diff", 0.5).select(F.col("q").alias(name))
    return median(by_step, "time_median").join(F.broadcast(median(by_key, "ensemble_median")))  # one row each


def huffman_bits(text: str) -> int:
    """Bits of a text in a Huffman code of its own characters; a text of one kind of character takes one bit each."""
    counts = list(Counter(text).values())
    if len(counts) < 2:
        return sum(counts)
    heapq.heapify(counts)
    bits = 0
    while len(counts) > 1:
        both = heapq.heappop(counts) + heapq.heappop(counts)
        bits += both
        heapq.heappush(counts, both)
    return bits


# Both sizes walk a text in Python: a code's merges and a compressor's state have no column functions.
# A batch stays in Arrow and gives out one text at a time, so a worker holds no second copy of it.
@F.arrow_udf(T.LongType())
def huffman_length(texts: pa.Array) -> pa.Array:
    return pa.array((huffman_bits(t.as_py() or "") for t in texts), pa.int64())


@F.arrow_udf(T.LongType())
def gzip_length(texts: pa.Array) -> pa.Array:
    def size(t: str | None) -> int:
        packer = zlib.compressobj(9, zlib.DEFLATED, 31)
        return len(packer.compress((t or "").encode()) + packer.flush())

    return pa.array((size(t.as_py()) for t in texts), pa.int64())


def _md5_number(key: Column, salt: str) -> Column:
    """The first eight hexadecimal digits of the MD5 of the key's text and a salt."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")


def stage_of(key: Column, stages: int) -> Column:
    """A fixed, disjoint assignment of rows to stages, by the MD5 of the key's text, so that other systems find the same."""
    return F.pmod(_md5_number(key, ""), F.lit(stages)).cast("int")


def sampled(key: Column, rate: float) -> Column:
    """Whether a row is in the fixed sample of this rate."""
    return F.pmod(_md5_number(key, ":sample"), F.lit(1_000_000)) < int(rate * 1_000_000)


#: Rows of a bin, about, that are put in order in one task.
RANKED = 100_000


def _hidden(rows: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that the rows do not have."""
    taken = {c.lower() for c in rows.columns}
    made = []
    for name in names:
        while name in taken:
            name += "_"
        made.append(name)
    return made


def _cut_off(rows: DataFrame, key: Column, order: Column, part: Callable[[Column, int], Column], stages: int, rate: float) -> DataFrame:
    """The rows in the order of a number, then of the key's text, cut from the front into stages of floor(rate x rows) each.

    Counts over ranges of that number (``part``, of the number and of how many ranges there may be at least) tell the place of
    every range; only ranges across which a cut goes are put in order, each in a task of its own."""
    o, text, of, at, first, last = _hidden(rows, "__o", "__text", "__of", "__at", "__first", "__last")
    kept = rows.columns
    rows = rows.filter(key.isNotNull()).withColumn(o, order).withColumn(text, key.cast("string"))
    total = rows.count()
    size = int(total * rate + 1e-9)
    if size * stages > total:
        raise ValueError(f"{stages} stages of {size} rows are more than the {total} rows")
    if not size:
        return rows.select(*kept, F.lit(0).alias("stage")).limit(0)
    rows = rows.withColumn(of, part(F.col(o), total // RANKED))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(at))  # a few rows for each RANKED rows
    counts = rows.groupBy(F.col(of).alias(at)).agg(F.count("*").alias("n"))
    ranges = settled(counts.select(at, (upto - F.col("n")).alias(first), (upto - 1).alias(last)))
    placed = rows.join(few(ranges), F.col(of) == F.col(at))
    stage = lambda place: F.floor(place / size).cast("int")
    whole = stage(F.col(first)) == stage(F.col(last))
    rank = F.row_number().over(Window.partitionBy(of).orderBy(o, text)) - 1 + F.col(first)
    known, cut = placed.filter(whole).withColumn("stage", stage(F.col(first))), placed.filter(~whole).withColumn("stage", stage(rank))
    return known.unionByName(cut).filter(F.col("stage") < stages).select(*kept, "stage")


def exact_stages(rows: DataFrame, key: Column, stages: int, rate: float) -> DataFrame:
    """The rows drawn into ``stages`` stages of exactly floor(rate x rows) each, without replacement, with their ``stage``.

    Rows stand in the order of their key's MD5 number, then of the key's text, and the stages are cut off from the front.
    Keys must be distinct for that: rows of one key are in one range.  Rows without a key take no part."""
    return _cut_off(rows, key, _md5_number(key, ""), lambda h, n: F.shiftright(h, 32 - min(24, max(4, n.bit_length()))), stages, rate)


def weighted_stages(rows: DataFrame, key: Column, weight: Column, stages: int, rate: float) -> DataFrame:
    """As ``exact_stages``, but rows are drawn one after the other with chances in proportion to their weights.

    Each row waits an exponential time, -ln(u) / weight with u from its key's MD5 number, and the first come first.  Ranges
    are slices of an octave of that time, so whatever the weights are, none holds more than about a quarter of an octave's
    rate: 0.26 / slices of the rows on average.  Rows whose weight is missing, not finite or not above 0, or without a
    key, take no part and do not count."""
    w = weight.cast("double")
    u = (_md5_number(key, "") + F.lit(0.5)) / F.lit(float(2**32))

    def part(wait: Column, ranges: int) -> Column:
        inside = F.least(F.greatest(wait, F.lit(1e-300)), F.lit(1e300))
        return F.floor(F.log2(inside) * F.lit(float(max(4, ranges)))).cast("long")

    held = rows.filter((w > 0) & (w < float("inf")))
    return _cut_off(held, key, F.try_divide(-F.log(u), w), part, stages, rate)
