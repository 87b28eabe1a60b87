"""Formulas as values: named fields, literals and operator calls, checked when built, known by their canonical text."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators import operator
from ..operators.registry import FLOAT, INT, PANEL, STR


@dataclass(frozen=True)
class Expr:
    """A call of an operator, or ``data`` of one field name."""

    name: str
    args: tuple

    def canonical(self) -> str:
        return f"{self.name}({', '.join(literal(a) for a in self.args)})"

    def __str__(self) -> str:
        return self.canonical()

    @property
    def inputs(self) -> tuple[Expr, ...]:
        return tuple(a for a in self.args if isinstance(a, Expr))

    def fields(self) -> set[str]:
        """Names of the panel's fields that the formula reads."""
        return {self.args[0]} if self.name == "data" else set().union(*(a.fields() for a in self.inputs)) if self.inputs else set()

    def replace(self, old: Expr, new: Expr) -> Expr:
        """The formula with every occurrence of ``old`` replaced."""
        if self == old:
            return new
        return Expr(self.name, tuple(a.replace(old, new) if isinstance(a, Expr) else a for a in self.args))

    def depth(self) -> int:
        return 1 + max((a.depth() for a in self.inputs), default=0)


def literal(value) -> str:
    if isinstance(value, Expr):
        return value.canonical()
    if isinstance(value, str):
        return '"' + value + '"'
    return repr(value)


def data(field: str) -> Expr:
    """A field of the panel."""
    if not isinstance(field, str):
        raise TypeError(f"data takes a field name, not {field!r}")
    return Expr("data", (field,))


def _kind(value) -> str:
    if isinstance(value, Expr):
        return PANEL
    return {bool: "bool", int: INT, float: FLOAT, str: STR}.get(type(value), type(value).__name__)


def op(name: str, *args) -> Expr:
    """A checked operator call.  A number where a panel is due stands for the constant panel."""
    wanted = operator(name).kinds
    if len(args) != len(wanted):
        raise TypeError(f"{name} takes {len(wanted)} arguments, not {len(args)}")
    for i, (value, kind) in enumerate(zip(args, wanted)):
        got = _kind(value)
        if got != kind and not (kind == PANEL and got in (INT, FLOAT)) and not (kind == FLOAT and got == INT):
            raise TypeError(f"argument {i + 1} of {name} is {got}, not {kind}")
    return Expr(name, tuple(args))
