"""Ranks, running totals and ranks within groups, without a single task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import materialize

#: Rows of a range; each range is ordered by one task.
RANGE_ROWS = 1_000_000


def ranged(df: DataFrame, order: list[Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` plus ``_range``: rows written in ranges of ``order``, as many as its rows need.
    The order must tell rows apart, so that no range is larger than the others."""
    parts = max(2, -(-df.count() // range_rows))
    return materialize(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def ranked_total(df: DataFrame, first: str, ties: list[Column], value: Column, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` plus ``rank`` (long, from 1) and ``cumulative`` in ascending order of the number
    ``first``, then ``ties``; nulls come first.

    Rows are cut into ranges of the whole order, each range is ordered by itself, and sums
    of the ranges before are added. An empty table gives an empty table.
    """
    cut = ranged(df.withColumn("_value", value), [F.col(first), *ties], range_rows)
    sums = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sums.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_total")
    )
    w = Window.partitionBy("_range").orderBy(first, *ties)
    own = cut.withColumns({"_i": F.row_number().over(w), "_run": F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return own.join(sums, "_range").select(
        *df.columns, (F.col("_i") + F.col("_rows")).cast("long").alias("rank"), (F.col("_run") + F.col("_total")).alias("cumulative")
    )


def at_ranks(df: DataFrame, group: str, value: str, ranks: dict[str, Column], *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(``group``, n, one column for each of ``ranks``): the value at 0-based ranks, written
    over ``n``, the rows of a group with a value; null where a rank is out of range.

    Equal values combine before the exchange. Distinct values are cut into ranges of (group,
    value), so a large group is ordered by many tasks; ranks of a range follow from the
    counts of the ranges before. Null values do not count; null is a group of its own.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_k"))
    cut = ranged(counts, [F.col(group), F.col(value)], range_rows)
    per = cut.groupBy(group, "_range").agg(F.sum("_k").alias("_s"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_s").over(Window.partitionBy(group)).alias("n"),
    )
    inside = Window.partitionBy(group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = cut.withColumn("_run", F.sum("_k").over(inside)).join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    end = F.col("_before") + F.col("_run")
    held = {k: F.max(F.when((r >= end - F.col("_k")) & (r < end), F.col(value))).alias(k) for k, r in ranks.items()}
    return at.groupBy(group).agg(F.first("n").alias("n"), *held.values())
