"""Operators by name: what arguments they take, how they see the panel, and the column they make."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: Kinds of arguments.
PANEL, INT, FLOAT, STR = "panel", "int", "float", "str"
#: What a value depends on: its own cell, its date's cells, or its instrument's earlier cells.
CELL, CROSS, TRAIL = "cell", "cross", "trail"


@dataclass(frozen=True)
class Operator:
    name: str
    kinds: tuple[str, ...]
    sees: str
    build: Callable
    #: Earlier rows that the value needs, from the scalar arguments; None: all of them.
    lookback: Callable[..., int | None] = lambda *_: 0
    #: For long windows: the same values as a function of (cache, whole series of an instrument ..., window's length);
    #: ``cache`` is one dict for all formulas of a wave over that instrument.
    series: Callable | None = None
    #: Of a cell operator: the value is missing wherever a panel argument is.
    keeps_gaps: bool = False


OPERATORS: dict[str, Operator] = {}
#: Windows of more rows than this are long: they are worked off by series instead of by frames, with equal values.
LONG = 32


def register(name: str, kinds: tuple[str, ...], sees: str, build: Callable, lookback: Callable[..., int | None] = lambda *_: 0, *, series: Callable | None = None, keeps_gaps: bool = False) -> Operator:
    """Adds an operator (users' own ones too).  ``build`` gets a Column per panel argument and Python scalars."""
    if sees not in (CELL, CROSS, TRAIL):
        raise ValueError(f"unknown view {sees!r}")
    OPERATORS[name] = made = Operator(name, tuple(kinds), sees, build, lookback, series, keeps_gaps)
    return made


def operator(name: str) -> Operator:
    try:
        return OPERATORS[name]
    except KeyError:
        raise KeyError(f"no operator named {name!r}") from None
