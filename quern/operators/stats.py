"""Statistics that differ in detail from Spark's own aggregates; ranks are over ``n``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(p: float) -> Column:
    """0-based: ceil(p n) - 1."""
    return F.greatest(F.ceil(F.col("n") * p) - 1, F.lit(0))


def floor_index(p: float) -> Column:
    """0-based: floor(p n)."""
    return F.floor(F.col("n") * p)


def middle_low() -> Column:
    return F.floor((F.col("n") - 1) / 2)


def middle_high() -> Column:
    return F.floor(F.col("n") / 2)
