"""Formulas, their evaluation in few shuffles, and batches of them."""

from .batch import evaluate_batch, fill, grid, slot
from .expr import Expr, data, op
from .evaluate import evaluate, evaluate_cells, lookback
from .weights import SlotWeights, draw, weighted_fill

__all__ = ["Expr", "SlotWeights", "data", "draw", "evaluate", "evaluate_batch", "evaluate_cells", "fill", "grid", "lookback", "op", "slot", "weighted_fill"]
