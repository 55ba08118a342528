"""Batch twins of the streaming operators, and the queue of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.registry import query
from quern.sources.tables import table
from quern.streaming.events import NEXT, legal


@query("""
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def hour_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM s GROUP BY user_id, session
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("was", F.lag("ts").over(w))
    near = F.expr("timestampdiff(MICROSECOND, was, ts)") <= 21600000000
    s = e.withColumn("session", F.sum(F.when(near, 0).otherwise(1)).over(w))
    g = s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    return g.select("user_id", "session", "n", F.expr("timestampdiff(MICROSECOND, a, z)").alias("span_us"))


_PAIRS = ", ".join(f"('{a}>{b}')" for a, bs in NEXT.items() for b in bs)


@query(f"""
WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, before, event_type FROM l WHERE before IS NOT NULL AND before || '>' || event_type NOT IN (VALUES {_PAIRS})
""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("before", before)
    return e.filter(~legal(F.col("before"), F.col("event_type"))).select("event_id", "user_id", "before", "event_type")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


JOBS_SQL = """WITH j AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'failed' ELSE 'running' END AS status,
  o_orderkey % 5 AS retry_count, 3 AS max_retries FROM orders)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: (o_orderkey, o_custkey, o_orderdate, status, retry_count, max_retries)."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.when(s == "O", "queued").when(s == "F", "failed").otherwise("running").alias("status"),
        (F.col("o_orderkey") % 5).alias("retry_count"), F.lit(3).alias("max_retries"),
    )


@query(JOBS_SQL + """ SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM j
WHERE status = 'queued' OR (status = 'failed' AND retry_count < max_retries) GROUP BY o_custkey""")
def queue_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each worker (customer) the oldest job that may run."""
    ready = jobs(spark, sf_dir).filter("status = 'queued' or (status = 'failed' and retry_count < max_retries)")
    return ready.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(JOBS_SQL + """ SELECT o_orderkey, CASE WHEN status = 'running' THEN 'queued' WHEN status = 'failed' AND retry_count >= max_retries THEN 'dead_letter' ELSE status END AS status,
  status = 'failed' AND retry_count = max_retries AS limbo FROM j""")
def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a crash: running jobs queue again, failed ones without retries are dead letters;
    limbo marks those that fail at the very last retry."""
    s = F.col("status")
    spent = (s == "failed") & (F.col("retry_count") >= F.col("max_retries"))
    status = F.when(s == "running", "queued").when(spent, "dead_letter").otherwise(s)
    limbo = (s == "failed") & (F.col("retry_count") == F.col("max_retries"))
    return jobs(spark, sf_dir).select("o_orderkey", status.alias("status"), limbo.alias("limbo"))


@query("""
SELECT user_id, substr(sha256(array_to_string(list_sort(list(DISTINCT event_type)), ',') || '|v1'), 1, 16) AS checksum FROM events GROUP BY user_id
""")
def checkpoint_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.sort_array(F.collect_set("event_type")), ",")  # five types at most
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.substring(F.sha2(F.concat(names, F.lit("|v1")), 256), 1, 16).alias("checksum"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'example') OR contains(lower(source), 'src1')")
def full_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter(F.contains(F.lower("text"), F.lit("example")) | F.contains(F.lower("source"), F.lit("src1"))).select("doc_id")


@query("""
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS tier FROM documents
""")
def size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    tier = F.when(n < 500, "small").when(n < 5000, "medium").otherwise("large")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), tier.alias("tier"))
