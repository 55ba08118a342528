"""Which texts hold which others, without comparing them pair by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a gram; shorter needles are grams of their own length.
GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    """(gram, at): every substring of ``size`` code points with its place, from 0."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.length(text) >= size, F.sequence(F.lit(0), F.length(text) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.substring(text, i + 1, size).alias("gram"), i.alias("at")))


def meetings(hays: DataFrame, needles: DataFrame) -> DataFrame:
    """(hay, needle) for every text of ``hays`` (hay) and of ``needles`` (needle) that it holds,
    once for each place.

    Each needle is known by its rarest gram in the hays, the least of equals, and where in it
    that stands. Needles with one gram at one place and of one length are looked for together:
    at each occurrence of the gram a hay is cut once, and what is cut meets the needles by
    equality. So rows follow from occurrences of rare grams, not from pairs, and a gram that
    very many hays have is split by the join as it is a plain equi-join.

    Nulls and empty texts hold nothing and are held by nothing; repeats count once. A hay goes
    along with each of its grams: they are to be names, segments or tokens, not whole texts.
    """
    h = hays.select("hay").filter("hay != ''").distinct()
    n = needles.select("needle").filter("needle != ''").distinct()
    hay, needle = F.col("hay"), F.col("needle")
    places = h.select("hay", F.explode(F.flatten(F.array(*(_grams(hay, k) for k in range(1, GRAM + 1))))).alias("g")).select("hay", "g.gram", "g.at")
    known = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = n.select("needle", F.explode(_grams(needle, F.least(F.length(needle), F.lit(GRAM)))).alias("g")).select("needle", "g.gram", F.col("g.at").alias("offset"))
    met = own.join(known, "gram", "left").groupBy("needle").agg(
        F.min_by(F.struct("gram", "offset"), F.struct("n", "gram", "offset")).alias("a"), F.bool_and(F.col("n").isNotNull()).alias("whole")
    )
    anchors = met.filter("whole").select("needle", "a.gram", "a.offset", F.length("needle").alias("size"))
    first = F.col("at") - F.col("offset")
    cut = places.join(anchors.select("gram", "offset", "size").distinct(), "gram").filter((first >= 0) & (first + F.col("size") <= F.length("hay")))
    return cut.select("hay", F.substring(hay, first + 1, F.col("size")).alias("needle")).join(anchors.select("needle"), "needle", "left_semi").select("hay", "needle")
