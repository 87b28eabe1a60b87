"""Weights of the operators that may fill a template's slot, and draws of candidates by them."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batch import fill, slot
from .expr import Expr


@dataclass(frozen=True)
class SlotWeights:
    """How likely each operator is in one slot; ``default`` holds for those without a weight, and weight 0 takes one out."""

    operators: Mapping[str, float]
    default: float = 1.0

    def __post_init__(self):
        for name, w in [*self.operators.items(), ("default", self.default)]:
            if not (math.isfinite(w) and w >= 0):
                raise ValueError(f"the weight of {name} is {w!r}, not a finite number of at least 0")

    def weight(self, name: str) -> float:
        return self.operators.get(name, self.default)

    def of(self, e: Expr) -> float:
        """The product of the weights of a formula's operators, one for each call; fields have none."""
        own = 1.0 if e.name == "data" else self.weight(e.name)
        return own * math.prod(self.of(a) for a in e.inputs)

    def scaled(self, name: str, factor: float) -> SlotWeights:
        """The same weights with one multiplied."""
        return SlotWeights({**self.operators, name: self.weight(name) * factor}, self.default)

    def mixed(self, other: SlotWeights) -> SlotWeights:
        """The mean of two sets of weights, each with its own default where it has no weight."""
        names = [*self.operators, *(n for n in other.operators if n not in self.operators)]
        return SlotWeights({n: (self.weight(n) + other.weight(n)) / 2 for n in names}, (self.default + other.default) / 2)

    def to_json(self) -> str:
        return json.dumps({"operators": dict(self.operators), "default": self.default})

    @classmethod
    def from_json(cls, text: str) -> SlotWeights:
        held = json.loads(text)
        return cls(held["operators"], held["default"])


def weighted_fill(template: Expr, params: Iterable[Expr], operators: Iterable[str], weights: SlotWeights, *, place: Expr | None = None, **choices) -> Iterator[tuple[Expr, float]]:
    """The fillings of ``fill`` with their weights, operators of weight 0 left out before anything is nested in them."""
    held = [name for name in operators if weights.weight(name) > 0]
    for e in fill(slot(), params, held, **choices):
        yield template.replace(place or slot(), e), weights.of(e)


def draw(spark: SparkSession, weighted: Iterable[tuple[Expr, float]], stages: int, rate: float) -> DataFrame:
    """(expr, weight, stage): formulas drawn by weight into ``stages`` stages of exactly floor(rate x formulas) each, none twice."""
    from ..operators.results import weighted_stages

    rows = [(e.canonical(), float(w)) for e, w in weighted]
    return weighted_stages(spark.createDataFrame(rows, "expr string, weight double"), F.col("expr"), F.col("weight"), stages, rate)
