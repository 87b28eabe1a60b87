"""Evaluation of formulas over a panel keyed by (t, inst).

Every distinct sub-formula becomes one column.  Columns are added in waves: all that can be had from cells and from
instruments' histories, then all that needs whole dates, and so on.  Windows of a wave share one exchange and, over
histories, one sort, so a plan has as many exchanges as the deepest formula has changes of view.  Long windows are
worked off by whole series in Arrow (one grouping by instrument, which has that exchange already).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constant, nz
from ..operators import operator
from ..operators.registry import CELL, CROSS, LONG, PANEL, TRAIL
from ..sources.panel import dense
from .expr import Expr

#: Rows of the panel that a task works off at once, if an instrument has not more.
STACK = 16_384


def lookback(expr: Expr) -> int | None:
    """Earlier rows of an instrument that a value of the formula can depend on; None: all."""
    if expr.name == "data":
        return 0
    spec = operator(expr.name)
    own = spec.lookback(*(a for a, kind in zip(expr.args, spec.kinds) if kind != PANEL))
    below = [lookback(a) for a in expr.inputs]
    if own is None or None in below:
        return None
    return own + max(below, default=0)


def _by_series(frame: DataFrame, todo: list[tuple]) -> DataFrame:
    """Adds columns that are functions of an instrument's whole series: (name, function, inputs, window), where an input
    is a column's name or a number that stands for a constant series."""

    def run(table: pa.Table) -> pa.Table:
        table, cache = table.sort_by("t"), {}
        series = {}
        for *_, inputs, _ in todo:
            for i in inputs:
                if i not in series:
                    series[i] = table.column(i).to_numpy(zero_copy_only=False).astype(float) if isinstance(i, str) else np.full(table.num_rows, float(i))
        for name, function, inputs, d in todo:
            out = function(cache, *(series[i] for i in inputs), d)
            table = table.append_column(name, pa.array(out, pa.float64(), mask=np.isnan(out)))
        return table

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields), *(f"{name} double" for name, *_ in todo)])
    return frame.groupBy("inst").applyInArrow(run, schema)


def _distinct(exprs) -> dict[str, Expr]:
    """Sub-formulas by canonical text, inputs before what uses them."""
    out: dict[str, Expr] = {}

    def walk(e: Expr) -> None:
        key = e.canonical()
        if key not in out:
            for a in e.inputs:
                walk(a)
            out[key] = e

    for e in exprs:
        walk(e)
    return out


def evaluate(panel: DataFrame, formulas: dict[str, Expr], *, t_from: int | None = None, t_to: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(t, inst, one column per formula, and the panel's columns named by ``keep``).

    With ``t_from`` and ``t_to`` only those rows are returned, and only they and the history they need are read."""
    nodes = _distinct(formulas.values())
    fields = set().union(*(e.fields() for e in formulas.values())) if formulas else set()
    unknown = sorted((fields | set(keep)) - set(panel.columns))
    if unknown:
        raise KeyError(f"the panel has no field {', '.join(unknown)}")
    if t_to is not None:
        panel = panel.filter(F.col("t") <= t_to)
    backs = [lookback(e) for e in formulas.values()]
    if t_from is not None and None not in backs:
        panel = panel.filter(F.col("t") >= t_from - max(backs, default=0))
    held: dict[str, Column] = {}
    column_of: dict[str, str] = {}
    names = {key: f"__e{i}" for i, key in enumerate(nodes)}
    fields_of = {f: f"__f{i}" for i, f in enumerate(sorted(fields))}
    frame = panel.select("t", "inst", *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), *(nz(F.col(f).cast("double")).alias(n) for f, n in fields_of.items()))

    def column(e: Expr) -> Column:
        args = []
        for a, kind in zip(e.args, operator(e.name).kinds):
            args.append(held[a.canonical()] if isinstance(a, Expr) else constant(a) if kind == PANEL else a)
        return operator(e.name).build(*args)

    wanted, kept = {e.canonical() for e in formulas.values()}, [f"__k{i}" for i in range(len(keep))]
    waiting = []
    for key, e in nodes.items():
        if e.name == "data":
            held[key], column_of[key] = F.col(fields_of[e.args[0]]), fields_of[e.args[0]]
        else:
            waiting.append((key, e))
    phase = (CELL, TRAIL)
    while waiting:
        moved = False
        while True:
            ready = [(k, e) for k, e in waiting if operator(e.name).sees in phase and all(a.canonical() in held for a in e.inputs)]
            if not ready:
                break
            moved = True
            whole = [(k, e) for k, e in ready if operator(e.name).series and e.inputs and e.args[-1] > LONG]
            apart = {k for k, _ in whole}
            if len(ready) > len(whole):
                frame = frame.select("*", *(column(e).alias(names[k]) for k, e in ready if k not in apart))
            if whole:
                asked = wanted | {a.canonical() for _, e in waiting for a in e.inputs}  # no other column travels to the workers
                own = [c for k, c in column_of.items() if k in asked] + [names[k] for k, _ in ready if k not in apart and k in asked]
                todo = [(names[k], operator(e.name).series, tuple(column_of[a.canonical()] if isinstance(a, Expr) else a for a in e.args[:-1]), e.args[-1]) for k, e in whole]
                frame = _by_series(frame.select("t", "inst", *kept, *dict.fromkeys(own)), todo)
            held |= {k: F.col(names[k]) for k, _ in ready}
            column_of |= {k: names[k] for k, _ in ready}
            done = {k for k, _ in ready}
            waiting = [(k, e) for k, e in waiting if k not in done]
            if phase == (CELL, CROSS):
                break
        if moved or waiting:
            phase = (CELL, CROSS) if phase == (CELL, TRAIL) else (CELL, TRAIL)
    out = frame.select("t", "inst", *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), *(held[e.canonical()].alias(n) for n, e in formulas.items()))
    return out if t_from is None else out.filter(F.col("t") >= t_from)


def _keeps_gaps(e) -> bool:
    """Whether a formula's value is missing wherever there is no cell."""
    return e.name == "data" or operator(e.name).keeps_gaps and bool(e.inputs) and all(map(_keeps_gaps, e.inputs))


def _of_cells(e: Expr) -> bool:
    """Whether an operator over series can work a formula off from the cells that are there.  Windows of one row have rules
    of their own."""
    return e.name != "data" and operator(e.name).series is not None and bool(e.inputs) and e.args[-1] > 1 and all(map(_keeps_gaps, e.inputs))


def evaluate_cells(cells: DataFrame, universe: DataFrame, n: int, formulas: dict[str, Expr]) -> DataFrame:
    """What ``evaluate(dense(cells, universe, n), formulas)`` gives, for cells that are one an ordinal of 0 ... n - 1 and
    instrument.

    Where all formulas are trailing operators over what is missing with its cell, only cells travel, and lie by instrument; the
    missing rows are made where the series are worked off, a few instruments at a time, so they are neither exploded, nor
    sorted, nor kept by windows.  Other formulas are evaluated over the dense panel."""
    if not formulas or not all(map(_of_cells, formulas.values())):
        return evaluate(dense(cells, universe, n), formulas)
    inputs = _distinct(a for e in formulas.values() for a in e.inputs)
    columns = {key: f"__i{i}" for i, key in enumerate(inputs)}
    held = evaluate(cells.filter(F.col("inst").isNotNull()), {columns[key]: e for key, e in inputs.items()}).withColumn("t", F.col("t").cast("int"))
    # A left join leaves all rows of a left row in one partition; merged, they are sorted as well.
    rows = universe.select("inst").distinct().hint("merge").join(held, "inst", "left")
    used = list(dict.fromkeys(columns[a.canonical()] for e in formulas.values() for a in e.inputs))
    todo = [(operator(e.name).series, [columns[a.canonical()] if isinstance(a, Expr) else float(a) for a in e.args[:-1]], e.args[-1]) for e in formulas.values()]
    schema = f"t int, inst {rows.schema['inst'].dataType.simpleString()}, " + ", ".join(f"`{name}` double" for name in formulas)

    def worked_off(insts: pa.Array, at: list[np.ndarray], cells: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        """All rows of these instruments, whose cells are at these ordinals."""
        out = np.empty((len(todo), len(insts), n))
        for i, (own, values) in enumerate(zip(at, cells)):
            cache, series = {}, {}
            for a in {a for _, args, _ in todo for a in args}:
                series[a] = np.full(n, np.nan if isinstance(a, str) else a)
                if isinstance(a, str):
                    series[a][own] = values[a]
            for k, (function, args, d) in enumerate(todo):
                out[k, i] = function(cache, *(series[a] for a in args), d)
        t, inst = pa.array(np.tile(np.arange(n, dtype=np.int32), len(insts))), insts.take(pa.array(np.repeat(np.arange(len(insts)), n)))
        return pa.RecordBatch.from_arrays([t, inst, *(pa.array(x.ravel(), mask=np.isnan(x).ravel()) for x in out)], names=["t", "inst", *formulas])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, some = None, max(1, STACK // max(n, 1))
        for batch in chain(batches, [None]):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            runs = pc.run_end_encode(table.column("inst").combine_chunks())
            insts, ends = runs.values, runs.run_ends.to_numpy()
            whole = len(ends) if batch is None else len(ends) - 1  # more of the last one may follow
            there = table.column("t").is_valid().to_numpy()  # an instrument without cells has one row without an ordinal
            at, values = table.column("t").to_numpy(), {c: table.column(c).to_numpy().astype(float) for c in used}
            rows_of = [np.arange(start, end)[there[start:end]] for start, end in zip([0, *ends[:-1]], ends[:whole])]
            for i in range(0, whole, some):
                part = rows_of[i : i + some]
                yield worked_off(insts[i : i + len(part)], [at[r].astype(int) for r in part], [{c: x[r] for c, x in values.items()} for r in part])
            rest = table.slice(ends[whole - 1] if whole else 0)

    return rows.select("t", "inst", *used).sortWithinPartitions("inst").mapInArrow(run, schema)
