"""Two sets of routes walked together as tries of segments.

A trie is a table of edges (parent, node, segment): a node is named by the segments that lead
to it, a parameter being ``:`` whatever its name. Both tries are walked from their roots
level by level; a state is a pair of nodes whose ways may stand for one path, with what is
still true of it. So routes meet only where all segments before agree, and ``**`` meets
what is below a node through the node, not route by route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import paths
from quern.scratch import materialize


def classes(routes: DataFrame, tag: str) -> DataFrame:
    """Routes (id, path, methods, api) that are alike in all but the id, as one with the least id,
    with their segments, ``keys``: the names of the nodes on their way, the root's first, and
    ``deep``: the node of the first ``**``."""
    alike = routes.groupBy("path", "methods", "api").agg(F.min("id").alias("id"))
    segment = F.transform(paths.segments(F.col("path")), lambda s: F.when(s["kind"] == "param", ":").otherwise(s["raw"]))
    named = alike.withColumn("segments", segment)
    keys = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda n: F.array_join(F.slice("segments", F.lit(1), n), "/"))
    first = F.array_position("segments", F.lit("**")).cast("int")
    named = named.withColumns({"keys": keys, "wild": F.exists("segments", lambda s: s.isin("*", "**"))})
    named = named.withColumn("deep", F.when(first > 0, F.get("keys", first)))
    return named.select(*(F.col(c).alias(f"{tag}{c}") for c in named.columns), F.element_at("keys", -1).alias(f"{tag}key"))


def _edges(routes: DataFrame, tag: str) -> DataFrame:
    at = routes.select(F.explode(F.arrays_zip(F.slice(f"{tag}keys", F.lit(1), F.size(f"{tag}segments")).alias("parent"), F.slice(f"{tag}keys", F.lit(2), F.size(f"{tag}segments")).alias("node"), F.col(f"{tag}segments").alias("segment"))).alias("e"))
    kind = F.when(F.col("e.segment").isin(":", "*"), "open").when(F.col("e.segment") == "**", "deep").otherwise("literal")
    return at.select(F.col("e.parent").alias(f"{tag}up"), F.col("e.node").alias(f"{tag}node"), F.col("e.segment").alias(f"{tag}segment"), kind.alias(f"{tag}kind")).distinct()


def walk(a: DataFrame, b: DataFrame, tag_a: str, tag_b: str) -> tuple[DataFrame, DataFrame]:
    """(met, deep) of two tables of :func:`classes`. met: pairs of nodes (a, b) of one depth whose
    ways may stand for one path; ``a_takes`` where every path of b's is one of a's, ``b_takes``
    the other way. deep: pairs (a, b, a_side) of the node of a ``**`` and a node of the
    other's, all below which it takes; ``a_side`` tells whose ``**`` it is.
    """
    ea = materialize(_edges(a, tag_a).withColumnsRenamed({f"{tag_a}{c}": f"a_{c}" for c in ("up", "node", "segment", "kind")}), "trie")
    eb = materialize(_edges(b, tag_b).withColumnsRenamed({f"{tag_b}{c}": f"b_{c}" for c in ("up", "node", "segment", "kind")}), "trie")
    spark = a.sparkSession
    state = spark.range(1).select(F.lit("").alias("a"), F.lit("").alias("b"), F.lit(True).alias("a_takes"), F.lit(True).alias("b_takes"))
    met, deep = state, None
    while True:
        from_a = state.join(ea, F.col("a") == F.col("a_up"))
        literal = from_a.filter("a_kind = 'literal'")
        equal = literal.join(eb.filter("b_kind = 'literal'"), (F.col("b") == F.col("b_up")) & (F.col("a_segment") == F.col("b_segment")))
        b_open = literal.join(eb.filter("b_kind != 'literal'"), F.col("b") == F.col("b_up")).withColumn("a_takes", F.lit(False))
        a_open = from_a.filter("a_kind != 'literal'").join(eb, F.col("b") == F.col("b_up")).withColumn("b_takes", F.col("b_takes") & (F.col("b_kind") != "literal"))
        pairs = materialize(equal.unionByName(b_open).unionByName(a_open).select("a", "b", "a_node", "b_node", "a_kind", "b_kind", "a_takes", "b_takes"), "walk")
        ended = pairs.filter("a_kind = 'deep' and a_takes").select(F.col("a_node").alias("a"), "b", F.lit(True).alias("a_side")).distinct()
        ended = ended.unionByName(pairs.filter("b_kind = 'deep' and b_takes").select("a", F.col("b_node").alias("b"), F.lit(False).alias("a_side")).distinct())
        deep = ended if deep is None else deep.unionByName(ended)
        state = pairs.select(
            F.col("a_node").alias("a"), F.col("b_node").alias("b"), (F.col("a_takes") & (F.col("a_kind") != "deep")).alias("a_takes"), (F.col("b_takes") & (F.col("b_kind") != "deep")).alias("b_takes")
        )
        if pairs.isEmpty():
            return met, deep
        met = met.unionByName(state)


def least_two(rows: DataFrame, key: str, id_: str, path: str) -> DataFrame:
    """For each ``key`` the rows with the two least ids of different paths: whatever path is then
    left out, one of them has the least id of the others."""
    per = rows.groupBy(key, path).agg(F.min(id_).alias(id_))
    return per.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(id_))).filter("_i <= 2").drop("_i")


def proper_prefixes(routes: DataFrame, tag: str, *more: str) -> DataFrame:
    """(prefix, ...): each route once for each node above its own."""
    return routes.select(F.explode(F.slice(f"{tag}keys", F.lit(1), F.size(f"{tag}segments"))).alias("prefix"), *more)


def hit(shared: Column, only: Column, size: Column, api: Column) -> Column:
    """What becomes of two routes of one path, by the methods that they share and lack."""
    return F.when(shared & api, "BLOCK").when(shared & (only == size), "RENAME").when(shared | (only > 0), "MERGE")
