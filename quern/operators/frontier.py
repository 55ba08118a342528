"""A crawl's frontier with a budget: breadth first, in the order of a queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import materialize


def crawl(seeds: DataFrame, links: DataFrame, *, max_pages: int = 200, max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(visited, skipped) of many crawls at once: seeds (crawl, node), one a crawl, and links (node,
    place, link, reason): what each page holds, in order of place, and why a crawl would not
    follow it (null: it would).

    visited: (crawl, node, depth, turn), the pages in the order of the queue: links of pages
    before others, of a page by place. skipped: (crawl, reason, n), how many links were left
    out: ``depth`` behind the last level, ``duplicate`` where the page was queued before,
    ``budget`` where ``max_pages`` were, else the link's own reason, checked in this order.

    A page is queued once: links to a page that waits in the queue are duplicates, as those to a
    page that was taken off it. A level is cut where the budget ends by a rank that Spark limits before it shuffles, so a
    task holds at most ``max_pages`` new pages of a crawl from each other. Null nodes and
    links are left out; pages without links end there; no seeds give no rows.
    """
    links = materialize(links.filter("node is not null and link is not null").select("node", "place", "link", "reason"), "links")
    seed = seeds.filter("node is not null").groupBy("crawl").agg(F.min("node").alias("node"))
    front = materialize(seed.select("crawl", "node", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("turn")), "front")
    visited, skipped, depth = front, None, 0
    while not front.isEmpty():
        order = F.struct("turn", "place")
        met = front.join(links, "node").select("crawl", order.alias("at"), F.col("link").alias("node"), "reason")
        if depth == max_depth:
            told = met.groupBy("crawl").agg(F.count(F.lit(1)).alias("n")).select("crawl", F.lit("depth").alias("reason"), "n")
            skipped = told if skipped is None else skipped.unionByName(told)
            break
        before = visited.groupBy("crawl").agg(F.count(F.lit(1)).alias("queued"))  # a row a crawl
        known = visited.select("crawl", "node", F.lit(True).alias("known"))
        met = materialize(met.join(known, ["crawl", "node"], "left").withColumn("known", F.coalesce("known", F.lit(False))), "met")
        new = met.filter("not known and reason is null").groupBy("crawl", "node").agg(F.min("at").alias("at"))
        i = F.row_number().over(Window.partitionBy("crawl").orderBy("at"))
        new = new.withColumn("i", i).filter(F.col("i") <= max_pages).join(before, "crawl").filter(F.col("queued") + F.col("i") <= max_pages)
        new = materialize(new.select("crawl", "node", "at", (F.col("queued") + F.col("i")).alias("turn")), "new")
        full = new.filter(F.col("turn") == max_pages).select("crawl", F.col("at").alias("last"))
        full = full.unionByName(before.filter(F.col("queued") >= max_pages).select("crawl", F.struct(F.lit(0).cast("long").alias("turn"), F.lit(0).cast(links.schema["place"].dataType).alias("place")).alias("last")))
        judged = met.join(new.select("crawl", "node", F.col("at").alias("first")), ["crawl", "node"], "left").join(full, "crawl", "left")
        reason = (
            F.when(F.col("known") | (F.col("at") > F.col("first")), "duplicate")
            .when((F.col("at") > F.col("last")) & F.coalesce(F.col("at") != F.col("first"), F.lit(True)), "budget").otherwise(F.col("reason"))
        )
        told = judged.withColumn("reason", reason).filter("reason is not null").groupBy("crawl", "reason").agg(F.count(F.lit(1)).alias("n"))
        skipped = told if skipped is None else skipped.unionByName(told)
        depth += 1
        front = new.select("crawl", "node", F.lit(depth).alias("depth"), "turn")
        visited = visited.unionByName(front)
    if skipped is None:
        skipped = front.select("crawl", F.lit("").alias("reason"), F.lit(0).cast("long").alias("n")).limit(0)
    return visited, skipped.groupBy("crawl", "reason").agg(F.sum("n").alias("n"))
