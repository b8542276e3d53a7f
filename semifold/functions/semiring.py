"""Commutative semirings: how values of factors combine along a join and collapse in a group."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    combine: Callable[[Column, Column], Column]
    collapse: Callable[[Column], Column]
    one: float


SUM_PRODUCT = Semiring(lambda a, b: a * b, F.sum, 1.0)
MAX_PRODUCT = Semiring(lambda a, b: a * b, F.max, 1.0)
MIN_SUM = Semiring(lambda a, b: a + b, F.min, 0.0)
MAX_SUM = Semiring(lambda a, b: a + b, F.max, 0.0)
BOOLEAN = Semiring(lambda a, b: ((a != 0) & (b != 0)).cast("double"), lambda v: F.max((v != 0).cast("double")), 1.0)
