"""Related pages of a site: the best five by shared parent, links, category, tags, slug and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEST, LEAST = 5, 15


def _base(p: str, c: str, segments: Column) -> Column:
    """What parents, categories, tags and ``segments`` give; ``p`` is the page, ``c`` the candidate."""
    a, b = (lambda n: F.col(f"{p}.{n}")), (lambda n: F.col(f"{c}.{n}"))
    return (
        F.when(a("parent") == b("parent"), 40).otherwise(0)
        + F.when((a("category") != "unknown") & (a("category") == b("category")), 20).otherwise(0)
        + F.size(F.array_intersect(a("tags"), b("tags"))) * 10
        + F.when(a("depth") > 1, segments * 5).otherwise(0)
    )


def _equal_places(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))


def _scores(p: str, c: str) -> Column:
    a, b = (lambda n: F.col(f"{p}.{n}")), (lambda n: F.col(f"{c}.{n}"))
    largest = F.greatest(F.size(a("words")), F.size(b("words")))
    alike = F.when(a("slug") == b("slug"), 1.0).when((F.size(a("words")) == 0) | (F.size(b("words")) == 0), 0.0)
    alike = alike.otherwise(F.size(F.array_intersect(a("words"), b("words"))) / largest)
    return (
        _base(p, c, _equal_places(a("parts"), b("parts")))
        + F.when(b("parent") == a("route"), 30).otherwise(0)
        + F.when(a("parent") == b("route"), 25).otherwise(0)
        + F.when(alike > 0.5, F.floor(alike * 15 + 0.5)).otherwise(0)
    ).cast("int")


def _rare_words(p: DataFrame) -> DataFrame:
    """(host, word, route): of each slug the rarer half of its words. Two slugs that share
    more than half of the larger one's words share one of these."""
    w = p.select("host", "route", F.explode(F.when(F.size("words") > 0, F.col("words")).otherwise(F.array("slug"))).alias("word"))
    n = w.groupBy("host", "word").agg(F.count(F.lit(1)).alias("n"))
    each = w.join(n, ["host", "word"]).groupBy("host", "route").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("ws"))
    return each.select("host", "route", F.explode(F.slice("ws.word", 1, F.ceil(F.size("ws") / 2).cast("int"))).alias("word"))


def related(pages: DataFrame) -> DataFrame:
    """(host, route, place, related, score) for ``pages`` (host, route, parent, parts, slug,
    words, category, tags, ord), one row a route of a host; ties go to the smaller ``ord``.

    Pages of one parent, category and tags get the same points from a page, but for slugs,
    parents and last segments. So six of each such class, and all that gain by one of
    those three, hold the best five of all pages of the site.
    """
    p = pages.withColumn("depth", F.size("parts"))
    key = ["host", "parent", "category", "tags", "depth"]
    first = Window.partitionBy(*key).orderBy("ord")
    heads = p.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= BEST + 1)
    classes = p.select(*key).distinct().withColumn("up", F.filter(F.split("parent", "/"), lambda s: s != ""))
    kinds = classes.alias("p").join(heads.alias("c"), F.col("p.host") == F.col("c.host"))
    above = _equal_places(F.col("p.up"), F.filter(F.split("c.parent", "/"), lambda s: s != ""))
    kinds = kinds.select(*(F.col(f"p.{k}").alias(k) for k in key), F.col("c.route").alias("other"), F.col("c.ord").alias("ord"), _base("p", "c", F.greatest(above, F.lit(0))).alias("base"))
    kinds = kinds.filter(F.col("base") >= LEAST)
    best = Window.partitionBy(*key).orderBy(F.desc("base"), "ord")
    kinds = kinds.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= BEST + 1).select(*key, "other")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"k.{k}"))
    pairs = p.alias("p").join(kinds.alias("k"), same).select("p.host", "p.route", "other")

    rare = _rare_words(p)
    pairs = pairs.unionByName(rare.join(rare.select("host", "word", F.col("route").alias("other")), ["host", "word"]).select("host", "route", "other"))
    up = p.filter("parent is not null").select("host", "route", F.col("parent").alias("other"))
    pairs = pairs.unionByName(up).unionByName(up.select("host", F.col("other").alias("route"), F.col("route").alias("other")))
    at = p.select("host", "route", "depth", F.posexplode("parts").alias("i", "segment"))
    last = at.filter(F.col("i") == F.col("depth") - 1).withColumnRenamed("route", "other").drop("depth")
    ends = at.filter("depth > 1").join(last, ["host", "i", "segment"]).select("host", "route", "other")
    last = last.select("host", "i", "segment", F.col("other").alias("route"))
    inside = last.filter("i > 0").join(at.select("host", "i", "segment", F.col("route").alias("other")), ["host", "i", "segment"]).select("host", "route", "other")
    pairs = pairs.unionByName(ends).unionByName(inside).filter("route != other").distinct()

    x = pairs.alias("x").join(p.alias("a"), (F.col("x.host") == F.col("a.host")) & (F.col("x.route") == F.col("a.route")))
    x = x.join(p.alias("b"), (F.col("x.host") == F.col("b.host")) & (F.col("x.other") == F.col("b.route")))
    x = x.select("x.host", "x.route", F.col("x.other").alias("related"), F.col("b.ord").alias("ord"), _scores("a", "b").alias("score")).filter(F.col("score") >= LEAST)
    place = F.row_number().over(Window.partitionBy("host", "route").orderBy(F.desc("score"), "ord"))
    return x.withColumn("place", place).filter(F.col("place") <= BEST).select("host", "route", "place", "related", "score")
