"""Queries that monitor a pipeline: orders are jobs, events what happens to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import GRADES, letter_grade
from quern.operators import ordered, stats
from quern.registry import query
from quern.sources.tables import table


@query("""
SELECT count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS partial, count(DISTINCT o_custkey) AS seeds, CAST(round(avg(o_totalprice)) AS BIGINT) AS mean_price FROM orders
""")
def global_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(status == "F").alias("failed"), F.count_if(status == "O").alias("open"),
        F.count_if(status == "P").alias("partial"), F.countDistinct("o_custkey").alias("seeds"), F.round(F.avg("o_totalprice")).cast("long").alias("mean_price"),
    )


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1
""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return counts.na.fill(0).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("""
WITH s AS (SELECT o_orderpriority AS stage, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY 1)
SELECT stage, total, failed, floor(failed * 1000.0::DOUBLE / total + 0.5) / 10.0::DOUBLE AS error_rate,
  CASE WHEN failed * 100.0::DOUBLE / total > 50 THEN 'critical' WHEN failed * 100.0::DOUBLE / total > 20 THEN 'degraded' ELSE 'healthy' END AS status FROM s
""")
def stage_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("failed")
    )
    rate = F.col("failed") * 100.0 / F.col("total")
    return s.select(
        "stage", "total", "failed", (F.floor(F.col("failed") * 1000.0 / F.col("total") + 0.5) / 10.0).alias("error_rate"),
        F.when(rate > 50, "critical").when(rate > 20, "degraded").otherwise("healthy").alias("status"),
    )


@query("""
WITH d AS (SELECT o_orderstatus, (epoch_us(max(l_shipdate)) - epoch_us(max(o_orderdate))) // 1000 AS ms
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus)
SELECT o_orderstatus, count(*) AS n, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS mean_ms, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS longest_ms FROM d GROUP BY o_orderstatus
""")
def latency_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ship dates combine per order before the join: one row an order is shuffled.
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("z"))
    jobs = table(spark, sf_dir, "orders").join(last, F.col("l_orderkey") == F.col("o_orderkey"))
    ms = F.expr("timestampdiff(MICROSECOND, o_orderdate, z) div 1000")
    return jobs.select("o_orderstatus", ms.alias("ms")).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.avg("ms") + 0.5).cast("long").alias("mean_ms"), F.sum("ms").alias("total_ms"), F.max("ms").alias("longest_ms")
    )


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 20
""")
def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report: the jobs that have waited longest."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_custkey")


@query("""
WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE i = greatest(ceil(n * 0.95::DOUBLE) - 1, 0)) AS p95_nearest, coalesce(max(value) FILTER (WHERE i = floor(n * 0.95::DOUBLE)), 0) AS p95_floor,
  max(value) FILTER (WHERE i = greatest(ceil(n * 0.5::DOUBLE) - 1, 0)) AS p50_nearest FROM o GROUP BY event_type
""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = {"p95_nearest": stats.nearest_rank(0.95), "p50_nearest": stats.nearest_rank(0.5), "p95_floor": stats.floor_index(0.95)}
    return ordered.at_ranks(table(spark, sf_dir, "events"), "event_type", "value", ranks).drop("n").na.fill(0.0, ["p95_floor"])


@query("""
SELECT event_type, median(value) AS median, stddev_pop(value) AS std_dev FROM events GROUP BY event_type
""")
def median_and_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    spread = e.groupBy("event_type").agg(F.stddev_pop("value").alias("std_dev"))
    middle = ordered.at_ranks(e, "event_type", "value", {"lo": stats.middle_low(), "hi": stats.middle_high()})
    middle = middle.select(F.col("event_type").alias("kind"), ((F.col("lo") + F.col("hi")) / 2).alias("median"))
    return spread.join(middle, F.col("event_type").eqNullSafe(F.col("kind")), "left").select("event_type", "median", "std_dev")


@query("""
WITH c AS (SELECT p_type, p_brand, count(*) AS k, min(p_partkey) AS f FROM part GROUP BY 1, 2)
SELECT p_type, p_brand AS mode, k FROM c QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY k DESC, f) = 1
""")
def mode_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("k"), F.min("p_partkey").alias("f"))
    best = c.groupBy("p_type").agg(F.max_by(F.struct("p_brand", "k"), F.struct("k", -F.col("f"))).alias("m"))
    return best.select("p_type", F.col("m.p_brand").alias("mode"), "m.k")


def _grade_sql(score: str, scale: str) -> str:
    return f"CASE WHEN {score} IS NULL THEN 'UNKNOWN' " + " ".join(f"WHEN {score} >= {a} THEN '{g}'" for a, g in GRADES[scale]) + " ELSE 'F' END"


@query(f"""
SELECT event_id, {_grade_sql('value * 2', 'qa')} AS qa, {_grade_sql('value * 2', 'reconstruction')} AS reconstruction,
  {_grade_sql('value / 50', 'similarity')} AS similarity, {_grade_sql('value * 2', 'certification')} AS certification FROM events
""")
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", letter_grade(v * 2, "qa").alias("qa"), letter_grade(v * 2, "reconstruction").alias("reconstruction"), letter_grade(v / 50, "similarity").alias("similarity"), letter_grade(v * 2, "certification").alias("certification"),
    )


@query("""
WITH c AS (SELECT event_type, count(*) FILTER (WHERE value > 60) AS fails, count(*) FILTER (WHERE value > 40) AS warns, count(*) AS checks FROM events GROUP BY event_type)
SELECT event_type, checks, fails, CASE WHEN fails > 0 THEN 'critical' WHEN warns > 0 THEN 'degraded' ELSE 'healthy' END AS worst FROM c
""")
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(F.col("value") > 60).alias("fails"), F.count_if(F.col("value") > 40).alias("warns"), F.count(F.lit(1)).alias("checks")
    )
    return c.select("event_type", "checks", "fails", F.when(F.col("fails") > 0, "critical").when(F.col("warns") > 0, "degraded").otherwise("healthy").alias("worst"))


@query("""
SELECT o_custkey AS seed, min(o_orderkey) AS parent, count(*) AS jobs, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CASE WHEN bool_or(o_orderstatus = 'P') THEN 'running' WHEN bool_or(o_orderstatus = 'O') THEN 'queued' ELSE 'failed' END AS status FROM orders GROUP BY o_custkey
""")
def job_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("seed")).agg(
        F.min("o_orderkey").alias("parent"), F.count(F.lit(1)).alias("jobs"), F.count_if(s == "F").alias("failed"),
        F.when(F.bool_or(s == "P"), "running").when(F.bool_or(s == "O"), "queued").otherwise("failed").alias("status"),
    )
