"""Operators on single cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee_div, nan_to_num, nz
from .registry import CELL, FLOAT, PANEL, register

TWO = (PANEL, PANEL)

register("add", TWO, CELL, lambda a, b: nz(a + b), keeps_gaps=True)
register("subtract", TWO, CELL, lambda a, b: nz(a - b), keeps_gaps=True)
register("multiply", TWO, CELL, lambda a, b: nz(a * b), keeps_gaps=True)
# Fixed values of this operator: missing 0, infinities +-1e9.
register("divide", TWO, CELL, lambda a, b: nan_to_num(ieee_div(a, b), 0.0, 1e9, -1e9))
register("flip", (PANEL,), CELL, lambda a: a * F.lit(-1.0), keeps_gaps=True)
register("pow", (PANEL, FLOAT), CELL, lambda a, x: nz(F.pow(a, F.lit(float(x)))), keeps_gaps=True)
register("sign", (PANEL,), CELL, lambda a: F.signum(a), keeps_gaps=True)
register("sigmoid", (PANEL,), CELL, lambda a: F.lit(1.0) / (F.lit(1.0) + F.exp(-a)), keeps_gaps=True)
