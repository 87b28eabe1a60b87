"""Batches of formulas: grids of literals, templates with a slot, and their evaluation to return series."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import OPERATORS
from ..operators.registry import FLOAT, INT, PANEL
from .evaluate import evaluate
from .expr import Expr, data, op

#: Formulas evaluated in one pass over the panel; more are worked off in passes.
PER_PASS = 100


def grid(template: Callable[..., Expr], **choices: Iterable) -> dict[str, Expr]:
    """All variants of a template, by canonical text."""
    names = list(choices)
    made = (template(**dict(zip(names, values))) for values in product(*(list(choices[n]) for n in names)))
    return {e.canonical(): e for e in made}


def slot(name: str = "slot") -> Expr:
    """A place in a template that ``fill`` replaces."""
    return data(f"<{name}>")


def fill(template: Expr, params: Iterable[Expr], operators: Iterable[str], *, ints: Iterable[int] = (), floats: Iterable[float] = (), depth: int = 1, place: Expr | None = None) -> Iterator[Expr]:
    """The template with its slot filled by every call of the given operators, nested up to ``depth``."""
    leaves, level = list(params), list(params)
    literals = {INT: list(ints), FLOAT: list(floats)}
    seen: set[str] = set()
    for _ in range(depth):
        made = []
        for name in operators:
            options = [level if k == PANEL else literals.get(k, []) for k in OPERATORS[name].kinds]
            for args in product(*options):
                e = op(name, *args)
                if e.canonical() not in seen:
                    seen.add(e.canonical())
                    made.append(e)
                    yield template.replace(place or slot(), e)
        level = leaves + made


def evaluate_batch(panel: DataFrame, formulas: dict[str, Expr], returns: str = "returns_d1") -> DataFrame:
    """(expr, t, ret): each formula's positions held against ``returns``; equal formulas once."""
    from ..operators.pool import backtest

    distinct = {e.canonical(): e for e in formulas.values()}
    keys, out = list(distinct), None
    for i in range(0, len(keys), PER_PASS):
        part = {f"p{j}": distinct[k] for j, k in enumerate(keys[i : i + PER_PASS])}
        series = backtest(evaluate(panel, part, keep=(returns,)), list(part), returns)
        names = F.create_map(*(F.lit(x) for j, k in enumerate(keys[i : i + PER_PASS]) for x in (f"p{j}", k)))
        series = series.select(names[F.col("expr")].alias("expr"), "t", "ret")
        out = series if out is None else out.unionByName(series)
    if out is None:
        raise ValueError("no formulas")
    return out
