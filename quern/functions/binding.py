"""Values that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often body uses it: without it an
    expression built of others grows with every use, and so does the time to plan it."""
    return F.get(F.transform(F.array(value), body), 0)
