"""Differences of two crawls and what they say over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of each key that comes last in ``order``; ties are for the caller to break."""
    cols = [c for c in df.columns if c != key]  # all of them travel: select before what is needed
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in cols))


def manifest_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): new, deleted, changed or unchanged, by full outer join on the key.

    Both sides need one row a key (see :func:`last_by_key`). A null digest differs from
    every other one but null.
    """
    a = before.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_a"))
    b = after.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_b"))
    status = (
        F.when(F.col("_a").isNull(), "new")
        .when(F.col("_b").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def page_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, reasons, more_words, images_added, images_gone) for the pages of both crawls that
    changed, that is whose ``hash`` differs; reasons in a fixed order.

    Both sides: one row a key with hash, title, description, published, images (array) and
    words; other columns are ignored. Nulls equal nulls only. Images count as a set, a null one
    is empty and so are null elements; words changed in structure if by more than a tenth of
    what there was, so never from none. Pages with a null key meet none.
    """
    facts = ("hash", "title", "description", "published", "images", "words")
    a = before.select(key, *(F.col(c).alias(f"_{c}") for c in facts))
    held = lambda c: F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    both = a.join(after.select(key, *facts), key).filter(~F.col("hash").eqNullSafe(F.col("_hash"))).withColumns({"images": held("images"), "_images": held("_images")})
    added, gone = F.size(F.array_except("images", "_images")), F.size(F.array_except("_images", "images"))
    old, more = F.coalesce(F.col("_words"), F.lit(0)), F.coalesce(F.col("words"), F.lit(0)) - F.coalesce(F.col("_words"), F.lit(0))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    reasons = F.array_compact(
        F.array(
            F.lit("contentHashChanged"), F.when(differs("title"), "titleChanged"), F.when((added > 0) | (gone > 0), "imageSetChanged"),
            F.when(differs("published") | differs("description"), "metadataChanged"), F.when((old > 0) & (F.abs(more) / F.greatest(old, F.lit(1)) > 0.1), "structureChanged"),
        )
    )
    return both.select(key, reasons.alias("reasons"), more.cast("long").alias("more_words"), added.cast("long").alias("images_added"), gone.cast("long").alias("images_gone"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: a count for each status and the share of pages that need no new crawl."""
    counts = diff.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "unchanged", "deleted")))
    scanned = F.col("new") + F.col("changed") + F.col("unchanged")
    rate = F.when(scanned > 0, F.floor(F.col("unchanged") * 1000.0 / scanned + 0.5) / 10.0).otherwise(0.0)
    return counts.withColumn("skip_rate", rate)


def hotspots(changes: DataFrame, key: str, runs: Column, high: int = 60, medium: int = 25) -> DataFrame:
    """Volatility of each key: changes per run as a percentage, and what it calls for."""
    score = F.floor(F.col("changes") * 100.0 / F.col("runs") + 0.5).cast("long")
    return (
        changes.groupBy(key)
        .agg(F.count(F.lit(1)).alias("changes"), F.max("day").alias("last_change"))
        .withColumn("runs", runs)
        .withColumn("volatility", F.when(F.col("runs") > 0, score).otherwise(F.lit(0)))
        .withColumn("priority", F.when(F.col("volatility") >= high, "HIGH").when(F.col("volatility") >= medium, "MEDIUM").otherwise("LOW"))
    )


def keep_newest(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each key, the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
