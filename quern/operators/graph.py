"""Trees and graphs over edge tables, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.scratch import materialize


def levels(edges: DataFrame, roots: DataFrame, max_depth: int | None = 5) -> DataFrame:
    """(node, depth): breadth first from ``roots`` (node) over ``edges`` (parent, child), every
    node at the first depth it is reached; without ``max_depth`` until nothing new is reached.

    Edges and the nodes of each level are written, so a level costs one join with the level
    before and one anti join with what is reached, however many levels came before.
    Null ends of edges are not followed; no roots give no rows.
    """
    edges = materialize(edges.select("parent", "child").filter("parent is not null and child is not null").distinct(), "edges")
    front = materialize(roots.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)), "level")
    reached, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = front.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        front = materialize(found.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


#: Levels that are joined in one plan, before it is written and the next begin.
ROUND = 4


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node, trail): the chain of parents of every row of (node, parent), nearest first and
    up to the root. A chain that leads back to a node in it stops there."""
    parents = nodes.select(F.col("node").alias("_up"), F.col("parent").alias("_next"))
    walk = nodes.select("node", "parent", F.array().cast("array<string>").alias("trail"))
    done = None
    while True:
        for _ in range(ROUND):
            walk = _up(walk, parents)
        walk = materialize(walk, "walk")
        ended = walk.filter("parent is null").select("node", "trail")
        done = ended if done is None else done.unionByName(ended)
        walk = walk.filter("parent is not null")
        if walk.isEmpty():
            return done


def _up(walk: DataFrame, parents: DataFrame) -> DataFrame:
    return walk.join(parents, F.col("parent") == F.col("_up"), "left").select(
        "node",
        F.when(~F.array_contains("trail", F.col("_up")) & (F.col("_up") != F.col("node")), F.col("_next")).alias("parent"),
        F.when(F.col("_up").isNull() | F.array_contains("trail", F.col("_up")) | (F.col("_up") == F.col("node")), F.col("trail"))
        .otherwise(F.concat("trail", F.array("_up")))
        .alias("trail"),
    )


def longest_levels(needs: DataFrame) -> DataFrame:
    """(node, depth) for a graph without cycles of (child, parent): the length of the longest way
    to each node, so that ordering by it puts every parent before its children.

    Each round takes off the nodes whose parents are all placed; a cycle is an error. The
    rounds are as many as the longest way is long.
    """
    needs = materialize(needs.select("child", "parent").distinct(), "needs")
    open_ = materialize(needs.select(F.explode(F.array("child", "parent")).alias("node")).distinct(), "open")
    placed, depth = None, 0
    while not open_.isEmpty():
        waiting = needs.join(open_.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node"))
        level = materialize(open_.join(waiting, "node", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            raise ValueError("the graph has a cycle")
        placed = level if placed is None else placed.unionByName(level)
        open_ = materialize(open_.join(level, "node", "left_anti"), "open")
        depth += 1
    return placed if placed is not None else open_.withColumn("depth", F.lit(0))
