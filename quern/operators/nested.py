"""Nested items of a tree, folded from the leaves up, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.scratch import materialize


def fold(nodes: DataFrame, item: Column, order: list[Column], *, top: int = 0, levels: int | None = None) -> DataFrame:
    """(node, parent, json) for every node at depth ``top`` of (node, parent, depth, ...): ``item``,
    a struct, as JSON with ``children``, its children folded the same way, in ``order``, as
    many as ``levels`` down (None: all).

    A level is one grouping of children by parent and one join, and is written, so a row
    holds what is nested in it and no more; a child is one depth below its parent, other
    children are left out. Null nodes are none; equal nodes are items of their own, each
    with all children; no nodes give no rows.
    """
    plain = nodes.filter("node is not null").select("node", "parent", "depth", F.struct(*order).alias("_order"), F.to_json(item).alias("_item"))
    plain = materialize(plain, "nodes")
    deepest = plain.agg(F.max("depth")).first()[0]
    if deepest is None:
        deepest = top
    last = deepest if levels is None else min(deepest, top + levels)
    below = None
    for depth in range(last, top - 1, -1):
        here = plain.filter(F.col("depth") == depth)
        inner = F.lit("")
        if below is not None:
            kids = below.groupBy(F.col("parent").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("_order", "node", "json"))).alias("_kids"))
            here = here.join(kids, F.col("node") == F.col("_of"), "left")
            inner = F.coalesce(F.array_join(F.transform("_kids", lambda k: k["json"]), ","), F.lit(""))
        json = F.concat(F.expr("left(_item, length(_item) - 1)"), F.lit(',"children":['), inner, F.lit("]}"))
        below = here.select("node", "parent", "_order", json.alias("json"))
        if depth > top:
            below = materialize(below, "folded")
    return (below if below is not None else plain.limit(0).withColumn("json", F.col("_item"))).select("node", "parent", "json")
