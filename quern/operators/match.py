"""Matching routes and sets: pattern joins, collisions, related pages, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(route: Column) -> Column:
    """A route with its numeric and bracketed segments as ``*``: the key of a pattern join."""
    return F.regexp_replace(route, r"/(\[[^\]]*\]|[0-9]+(\.html)?)", "/*")


def jaccard_percent(a: Column, b: Column) -> Column:
    """Shared share of two arrays in percent; two empty ones agree, one empty does not."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 100.0).otherwise(both * 100.0 / either)


def overlap(a: Column, b: Column) -> Column:
    largest = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(largest == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / largest)


def best_per_key(df: DataFrame, key: list[str], score: Column, keep: list[str]) -> DataFrame:
    """The row of each key with the highest ``score`` (a struct that breaks ties)."""
    best = df.groupBy(*key).agg(F.max_by(F.struct(*keep), score).alias("_b"))
    return best.select(*key, *(F.col(f"_b.{c}").alias(c) for c in keep))
