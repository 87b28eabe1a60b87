"""Formulas kept up to date over streams of panel rows.

A formula's sub-formulas fall into the same waves as in batch: those that need an instrument's history, then those that
need whole dates, and so on.  Each wave is one stateful operator:

* by instrument, with a ring buffer for every trailing sub-formula: the rows of its inputs that later values can depend
  on, and no more.  Instruments are dealt to ``BUCKETS`` keys, and what is kept of a key's instruments is read and written
  at once, so that calls of the state store do not grow with the instruments;
* by date, with the rows of dates that are still open.  A date is worked off when all its instruments are there, without
  being kept if they come together; its rows go at once, and what is left is a mark that turns away repeats.  Dates are event time: once a later one has come by so
  much that the watermark is past a date, its rows are late and left out, and a timer removes its mark, or its rows if it
  never was complete.

Waves hand over to each other through a streaming sink and source (``run_waves``), since each keeps state of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import nz
from ..operators import operator
from ..operators.registry import CROSS, PANEL, TRAIL
from ..plans.expr import Expr
from .arrays import applied

#: The state store that these operators need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def waves(formulas: dict[str, Expr]) -> list[tuple[bool, dict[str, Expr]]]:
    """(by date, sub-formulas by canonical text in order) of every wave."""
    nodes: dict[str, Expr] = {}

    def walk(e: Expr) -> None:
        if e.canonical() not in nodes:
            for a in e.inputs:
                walk(a)
            nodes[e.canonical()] = e

    for e in formulas.values():
        walk(e)
    held = {k for k, e in nodes.items() if e.name == "data"}
    waiting = {k: e for k, e in nodes.items() if k not in held}
    out, by_date = [], False
    while waiting:
        wave: dict[str, Expr] = {}
        for k, e in waiting.items():  # inputs stand before what uses them
            other = TRAIL if by_date else CROSS
            if operator(e.name).sees != other and all(a.canonical() in held or a.canonical() in wave for a in e.inputs):
                wave[k] = e
        if wave:
            out.append((by_date, wave))
            held |= set(wave)
            waiting = {k: e for k, e in waiting.items() if k not in wave}
        by_date = not by_date
    return out or [(False, {})]


def _reach(e: Expr) -> int | None:
    """Earlier rows of its own inputs that a trailing operator looks at; None: back to the last value that is there."""
    spec = operator(e.name)
    return spec.lookback(*(a for a, kind in zip(e.args, spec.kinds) if kind != PANEL))


#: A date's ordinal stands for a day of event time, counted from a day before which no watermark is.
DAY_MS, DAY_0 = 86_400_000, 36_525

#: Keys of state that instruments share.
BUCKETS = 512
#: A state partition is opened for so many instruments; there are ``FEWEST`` at least, and the session's shuffle partitions
#: at most.
PARTITION_INSTRUMENTS, FEWEST = 2000, 4


class _Wave:
    """The sub-formulas of a wave over rows of arrays."""

    def __init__(self, nodes: dict[str, Expr], inputs: dict[str, str], outputs: list[str]):
        self.nodes, self.inputs, self.outputs = nodes, inputs, outputs

    def run(self, rows: dict[str, np.ndarray], n: int, before: dict[str, list[np.ndarray]]) -> tuple[dict[str, np.ndarray], dict[str, list[np.ndarray]]]:
        """The outputs of n new rows, given the rows kept of trailing inputs; and the rows to keep from now on."""
        held = {k: rows[c] for k, c in self.inputs.items()}
        kept: dict[str, list[np.ndarray]] = {}
        for key, e in self.nodes.items():
            args = [held[a.canonical()] if isinstance(a, Expr) else np.full(n, float(a)) if kind == PANEL else a for a, kind in zip(e.args, operator(e.name).kinds)]
            if operator(e.name).sees == TRAIL:
                panels = [i for i, kind in enumerate(operator(e.name).kinds) if kind == PANEL]
                for i, own in zip(panels, before.get(key, ())):
                    args[i] = np.concatenate([own, args[i]])
                reach = _reach(e)
                if reach is None:  # the last value that is there
                    kept[key] = [args[panels[0]][~np.isnan(args[panels[0]])][-1:]]
                else:
                    kept[key] = [args[i][len(args[i]) - min(reach, len(args[i])) :] for i in panels]
            held[key] = np.asarray(applied(e.name, args), dtype=float)[-n:] if n else np.zeros(0)
        return {k: held[k] for k in self.outputs}, kept

    def rings(self) -> list[tuple[str, int]]:
        """The trailing sub-formulas and how many series are kept of each."""
        own = [(k, e) for k, e in self.nodes.items() if operator(e.name).sees == TRAIL]
        return [(k, 1 if _reach(e) is None else operator(e.name).kinds.count(PANEL)) for k, e in own]


def _table(t: int | np.ndarray, inst: list | np.ndarray, values: dict[str, np.ndarray]) -> pd.DataFrame:
    """Rows to give out; what is missing is null there, not NaN."""
    out = pd.DataFrame({"inst": inst}).assign(t=t)
    for c, x in values.items():
        missing = np.isnan(x)
        out[c] = np.where(missing, None, x.astype(object)) if missing.any() else x
    return out


class _ByInstrument(StatefulProcessor):
    """Rows of a bucket's instruments, each in order of dates; a row at or before the last date seen of its instrument is late
    and left out."""

    def __init__(self, wave: _Wave, names: list[str], carried: list[str], inst_type: str):
        self.wave, self.names, self.carried, self.inst_type = wave, names, carried, inst_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", f"insts array<{self.inst_type}>, last binary, sizes binary, rings binary")

    def before(self) -> tuple[dict, np.ndarray, list[dict[str, list[np.ndarray]]]]:
        """Every instrument's place in the bucket; by place, the last date and the rows kept of each trailing sub-formula."""
        if not self.bucket.exists():
            return {}, np.zeros(0, dtype=np.int64), []
        insts, last, sizes, values = self.bucket.get()
        ends = np.cumsum(np.frombuffer(sizes, dtype=np.int32)).tolist()
        values, at, begin, rings = np.frombuffer(values, dtype=float), iter(ends), 0, []
        for _ in insts:
            own: dict[str, list[np.ndarray]] = {}
            for k, parts in self.wave.rings():
                own[k] = []
                for end in itertools.islice(at, parts):
                    own[k].append(values[begin:end])
                    begin = end
            rings.append(own)
        return {inst: place for place, inst in enumerate(insts)}, np.frombuffer(last, dtype=np.int64).copy(), rings

    def keep(self, places: dict, last: np.ndarray, rings: list[dict[str, list[np.ndarray]]]) -> None:
        series = [part for own in rings for k, _ in self.wave.rings() for part in own[k]]
        sizes = np.array([len(x) for x in series], dtype=np.int32)
        self.bucket.update((list(places), last.tobytes(), sizes.tobytes(), np.concatenate([np.zeros(0), *series]).tobytes()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        places, last, rings = self.before()
        codes, insts = pd.factorize(new["inst"], use_na_sentinel=False)
        insts = [None if key[0] < 0 else inst for inst in insts.tolist()]
        place = np.array([places.setdefault(inst, len(places)) for inst in insts])[codes]
        last = np.concatenate([last, np.full(len(places) - len(last), np.iinfo(np.int64).min)])
        rings += [{} for _ in range(len(places) - len(rings))]
        t = new["t"].to_numpy(dtype=np.int64)
        order = np.lexsort((t, place))  # stable: of rows of one date the first counts
        place, t = place[order], t[order]
        fresh = t > last[place]
        fresh[1:] &= (place[1:] != place[:-1]) | (t[1:] != t[:-1])
        order, place, t = order[fresh], place[fresh], t[fresh]
        if not len(order):
            return
        columns = {c: new[c].to_numpy(dtype=float)[order] for c in {*self.carried, *self.wave.inputs.values()}}
        made = {name: np.empty(len(order)) for name in self.names}
        ends = (np.flatnonzero(np.diff(place, append=-1)) + 1).tolist()
        for a, b in zip([0, *ends], ends):
            found, rings[place[a]] = self.wave.run({c: x[a:b] for c, x in columns.items()}, b - a, rings[place[a]])
            for name, x in zip(self.names, found.values()):
                made[name][a:b] = x
            last[place[a]] = t[b - 1]
        self.keep(places, last, rings)
        yield _table(t, new["inst"].to_numpy()[order], {c: columns[c] for c in self.carried} | made)

    def close(self) -> None:
        pass


class _ByDate(StatefulProcessor):
    """Rows of a date, held until ``instruments`` of them are there; repeats of an instrument are left out."""

    def __init__(self, wave: _Wave, names: list[str], carried: list[str], instruments: int, lag: int, inst_type: str):
        self.wave, self.names, self.carried, self.instruments, self.lag, self.inst_type = wave, names, carried, instruments, lag, inst_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", f"inst {self.inst_type}", "cells array<double>")
        self.closed = handle.getValueState("closed", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)  # all of them, also where nothing is done
        if self.closed.exists():
            return
        self.handle.registerTimer(DAY_MS * (int(key[0]) + DAY_0) + 1)
        columns = list(dict.fromkeys([*self.carried, *self.wave.inputs.values()]))
        if not self.open.exists():
            new = pd.concat(frames).drop_duplicates("inst")
            if len(new) >= self.instruments:  # complete at once: nothing to keep
                self.closed.update((True,))
                yield self.finished(int(key[0]), new["inst"].tolist(), new[columns].astype(float))
                return
        for frame in frames:
            for inst, *cells in zip(frame["inst"].tolist(), *(frame[c].to_numpy(dtype=float).tolist() for c in columns)):
                if not self.open.containsKey((inst,)):
                    self.open.updateValue((inst,), ([None if v != v else v for v in cells],))
        held = {k[0]: v[0] for k, v in self.open.iterator()}
        if len(held) < self.instruments:
            return
        self.open.clear()
        self.closed.update((True,))
        yield self.finished(int(key[0]), list(held), pd.DataFrame([[*cells] for cells in held.values()], columns=columns, dtype=float))

    def finished(self, t: int, insts: list, table: pd.DataFrame) -> pd.DataFrame:
        found, _ = self.wave.run({c: table[c].to_numpy() for c in self.wave.inputs.values()}, len(table), {})
        return _table(t, insts, {c: table[c].to_numpy() for c in self.carried} | dict(zip(self.names, found.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.closed.clear()
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def formula_waves(formulas: dict[str, Expr], *, instruments: int, lag: int = 30) -> list[Callable[[DataFrame], DataFrame]]:
    """One function for each wave, from the stream of the wave before; the first takes (t, inst, fields), the last gives
    (t, inst, a column a formula).  Dates may lag ``lag`` dates behind the latest one."""
    plan, ready = waves(formulas), []
    fields = sorted(set().union(*(e.fields() for e in formulas.values())))
    held = {Expr("data", (f,)).canonical(): f"f_{f}" for f in fields}
    for i, (by_date, nodes) in enumerate(plan):
        later = {e.canonical() for e in formulas.values()} | {a.canonical() for _, rest in plan[i + 1 :] for e in rest.values() for a in e.inputs}
        inputs = {a.canonical(): held[a.canonical()] for e in nodes.values() for a in e.inputs if a.canonical() in held}
        carried = {k: c for k, c in held.items() if k in later}
        names = {k: f"w{i}_{j}" for j, k in enumerate(k for k in nodes if k in later)}
        ready.append((by_date, _Wave(nodes, inputs, list(names)), list(names.values()), list(carried.values())))
        held = carried | names
    last = [held[e.canonical()] for e in formulas.values()]

    def step(i: int) -> Callable[[DataFrame], DataFrame]:
        by_date, wave, names, carried = ready[i]

        def run(rows: DataFrame) -> DataFrame:
            if i == 0:
                rows = rows.select(F.col("t").cast("long").alias("t"), "inst", *(nz(F.col(f).cast("double")).alias(f"f_{f}") for f in fields))
            kind = rows.schema["inst"].dataType.simpleString()
            schema = ", ".join(["t long", f"inst {kind}", *(f"`{c}` double" for c in [*carried, *names])])
            if by_date:
                made = _ByDate(wave, names, carried, instruments, lag, kind)
                dated = rows.withColumn("at", F.timestamp_seconds((F.col("t") + DAY_0) * (DAY_MS // 1000))).withWatermark("at", f"{lag} days")
                out = dated.groupBy("t").transformWithStateInPandas(made, schema, "Append", "EventTime")
            else:
                bucket = F.when(F.col("inst").isNull(), -1).otherwise(F.pmod(F.xxhash64("inst"), F.lit(BUCKETS))).cast("int")
                out = rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(_ByInstrument(wave, names, carried, kind), schema, "Append", "None")
            return out.select("t", "inst", *(F.col(c).alias(n) for c, n in zip(last, formulas))) if i == len(ready) - 1 else out

        return run

    return [step(i) for i in range(len(ready))]


def run_waves(spark: SparkSession, source: DataFrame, formulas: dict[str, Expr], folder: str, *, instruments: int, lag: int = 30) -> DataFrame:
    """Works off what the stream ``source`` of (t, inst, fields) has for now, wave by wave, and gives the rows worked out so
    far.  State and rows between waves are in ``folder``; a further call with the same folder goes on where this ended."""
    if spark.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"formula streams need {STORE[0]} = {STORE[1]}")
    stream, most = source, spark.conf.get("spark.sql.shuffle.partitions")
    for i, wave in enumerate(formula_waves(formulas, instruments=instruments, lag=lag)):
        made = wave(stream)
        writer = made.writeStream.format("parquet").option("path", f"{folder}/wave-{i}").option("checkpointLocation", f"{folder}/state-{i}").outputMode("append").trigger(availableNow=True)
        spark.conf.set("spark.sql.shuffle.partitions", min(int(most), max(FEWEST, -(-instruments // PARTITION_INSTRUMENTS))))
        try:
            query = writer.start()  # has a copy of the settings
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", most)
        query.awaitTermination()
        stream = spark.readStream.schema(made.schema).parquet(f"{folder}/wave-{i}")
    return spark.read.schema(made.schema).parquet(f"{folder}/wave-{i}")
