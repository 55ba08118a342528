"""Queries over runs and snapshots in time: events are runs, user_id the page or job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import diff, ordered
from quern.registry import query
from quern.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def micros(a: str, b: str):
    return F.expr(f"timestampdiff(MICROSECOND, {a}, {b})")


@query("""
WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error'),
r AS (SELECT count(DISTINCT strftime(ts, '%Y-%m-%d')) AS runs FROM events),
h AS (SELECT user_id, count(*) AS changes, max(day) AS last_change, max(runs) AS runs FROM c CROSS JOIN r GROUP BY user_id),
v AS (SELECT *, CAST(floor(changes * 100.0::DOUBLE / runs + 0.5) AS BIGINT) AS volatility FROM h)
SELECT *, CASE WHEN volatility >= 60 THEN 'HIGH' WHEN volatility >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM v
""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    runs = e.agg(F.countDistinct("day").alias("runs")).first()["runs"]  # one number
    return diff.hotspots(e.filter("event_type = 'error'"), "user_id", F.lit(runs))


@query("""
SELECT event_type, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us,
  count(*) / (greatest(epoch_us(max(ts)) - epoch_us(min(ts)), 86400000000) / 604800000000.0::DOUBLE) AS per_week FROM events GROUP BY event_type
""")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    span = micros("a", "z")
    return g.select("event_type", "n", span.alias("span_us"), (F.col("n") / (F.greatest(span, F.lit(86400000000)) / 604800000000.0)).alias("per_week"))


@query("""
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS skipped FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT day, skipped, CAST(sum(skipped) OVER (ORDER BY day) AS BIGINT) AS so_far, CAST(sum(skipped) OVER (ORDER BY day) * 81920 AS BIGINT) AS bytes_saved FROM d
""")
def savings_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).filter("event_type = 'view'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("skipped"))
    return days.withColumn("so_far", F.sum("skipped").over(Window.orderBy("day"))).withColumn("bytes_saved", F.col("so_far") * 81920)


@query("""
SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS generation, lag(event_id) OVER w AS previous,
  round(value - lag(value) OVER w, 2) AS delta, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).withColumns({"before": F.lag("ts").over(w), "was": F.lag("value").over(w)})
    return e.select(
        "event_id", "user_id", F.row_number().over(w).alias("generation"), F.lag("event_id").over(w).alias("previous"),
        F.round(F.col("value") - F.col("was"), 2).alias("delta"), micros("before", "ts").alias("gap_us"),
    )


@query("""
WITH g AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(max(ts) FILTER (WHERE event_type = 'purchase')) AS idle FROM events GROUP BY user_id)
SELECT user_id, idle, CASE WHEN idle IS NULL THEN 'never' WHEN idle > 36000000000 THEN 'stalled' WHEN idle > 7200000000 THEN 'slow' ELSE 'healthy' END AS state FROM g
""")
def stall_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    g = e.groupBy("user_id").agg(F.max("ts").alias("z"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("a"))
    g = g.select("user_id", micros("a", "z").alias("idle"))
    state = F.when(F.col("idle").isNull(), "never").when(F.col("idle") > 36000000000, "stalled").when(F.col("idle") > 7200000000, "slow").otherwise("healthy")
    return g.withColumn("state", state)


@query("""
WITH f AS (SELECT user_id, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS z, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN span > 0 THEN (z - a) / (span / 3600000000.0::DOUBLE) ELSE 0.0 END AS slope FROM f
""")
def first_last_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    f = _events(spark, sf_dir).groupBy("user_id").agg(
        F.min_by("value", order).alias("a"), F.max_by("value", order).alias("z"), F.min("ts").alias("t0"), F.max("ts").alias("t1")
    ).withColumn("span", micros("t0", "t1"))
    return f.select("user_id", F.when(F.col("span") > 0, (F.col("z") - F.col("a")) / (F.col("span") / 3600000000.0)).otherwise(0.0).alias("slope"))


@query("""
SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50
""")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.keep_newest(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id")


@query("""
WITH ok AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT e.event_id, max(ok.event_id) AS last_good FROM events e LEFT JOIN ok ON ok.user_id = e.user_id AND ok.event_id < e.event_id GROUP BY e.event_id
""")
def previous_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return _events(spark, sf_dir).select("event_id", F.max(good).over(w).alias("last_good"))


@query("""
WITH b AS (SELECT event_type AS base, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n, user_id FROM events)
SELECT event_id, base || '-' || user_id || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS name FROM b
""")
def collision_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    base = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    return _events(spark, sf_dir).select("event_id", F.concat(base, F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")).alias("name"))


@query(r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<h([1-6])[\s>]', 1) AS hs FROM pages),
x AS (SELECT page_id, unnest(hs) AS lv, generate_subscripts(hs, 1) AS pos FROM h),
l AS (SELECT page_id, CAST(lv AS INTEGER) AS lv, lag(CAST(lv AS INTEGER)) OVER (PARTITION BY page_id ORDER BY pos) AS was FROM x),
s AS (SELECT page_id, count(*) FILTER (WHERE lv > was + 1) AS skips, count(*) FILTER (WHERE lv = 1) AS h1 FROM l GROUP BY page_id)
SELECT h.page_id, coalesce(skips, 0) AS skips, coalesce(h1, 0) = 1 AS one_h1 FROM h LEFT JOIN s USING (page_id)
""")
def heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Levels of a page are an array in order, so neighbours meet without a shuffle.
    levels = F.transform(F.regexp_extract_all("html", F.lit(r"<h([1-6])[\s>]"), F.lit(1)), lambda x: x.cast("int"))
    jumps = F.filter(F.sequence(F.lit(1), F.greatest(F.size("lv") - 1, F.lit(1))), lambda i: F.get("lv", i) > F.get("lv", i - 1) + 1)
    return table(spark, sf_dir, "pages").select("page_id", levels.alias("lv")).select(
        "page_id", F.size(jumps).cast("long").alias("skips"), (F.size(F.filter("lv", lambda x: x == 1)) == 1).alias("one_h1")
    )


@query("""
WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT p_partkey, rank, CAST(sum(p_size) OVER (ORDER BY rank) AS BIGINT) AS cumulative FROM r
""")
def ranked_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", (-F.col("p_retailprice")).alias("order"))
    return ordered.ranked_total(part, "order", [F.col("p_partkey")], F.col("p_size").cast("long")).select("p_partkey", "rank", "cumulative")
