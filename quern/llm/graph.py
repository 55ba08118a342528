"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import read_back, remove, write_out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) with u > v: every neighbour is hung on the smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        return hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node it reaches.

    Loops and repeated edges are allowed; no edges give no rows. Each round is written to
    the shared folder, so lineage stays short and a lost executor costs one round.
    """
    spark = edges.sparkSession
    clean = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    path = write_out(clean, "edges")
    current, sign = read_back(spark, path, clean), None
    while True:  # every round that changes anything brings nodes nearer to their smallest
        stepped = _star(_star(current, True).distinct(), False).filter("u != v").distinct()
        new = write_out(stepped, "edges")
        remove(spark, path)
        path, current = new, read_back(spark, new, stepped)
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == sign:
            break
        sign = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
