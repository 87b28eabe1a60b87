"""The panel operators and their registry."""

from . import cross_section, elementwise, time_series  # noqa: F401  they register themselves
from .registry import OPERATORS, Operator, operator, register

__all__ = ["OPERATORS", "Operator", "operator", "register"]
