"""Queries that classify failures. Events are failed jobs; their messages are a fixture, as the
tables hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import failures
from quern.registry import query
from quern.sources.tables import table

_MESSAGES = (
    "ManifestVerificationError: _manifest.json missing", "FATAL: JavaScript heap out of memory", "HTTP 429 Too Many Requests", "Response status 503 Service Unavailable",
    "Protocol error: Target closed", "getaddrinfo ENOTFOUND a.b", "connect ETIMEDOUT, socket hang up", "ENOSPC: disk full, write failed", "checkpoint: saveManifest failed",
    "SyntaxError: Unexpected token < in JSON.parse", "fetch failed with status 404", "TypeError: x is not a function", "nothing known",
)

# Worked out by hand from the messages: class, confidence, risk, advice of each.
FAILED_SQL = """WITH a(i, failure, confidence, risk, advice) AS (VALUES (0, 'ManifestFailure', 95, 'high', 'retry_with_backoff'), (1, 'OOM', 97, 'critical', 'retry_with_backoff'), (2, '429RateLimit', 95, 'medium', 'retry_with_backoff'),
  (3, '5xxServerError', 90, 'medium', 'retry_with_backoff'), (4, 'BrowserCrash', 93, 'high', 'retry_with_backoff'), (5, 'DNSFailure', 96, 'high', 'retry_after_fix'), (6, 'NetworkTimeout', 92, 'medium', 'retry_with_backoff'),
  (7, 'StorageFailure', 88, 'high', 'retry_after_fix'), (8, 'CheckpointFailure', 85, 'medium', 'retry_with_backoff'), (9, 'ParserFailure', 87, 'medium', 'retry_with_backoff'), (10, 'HTTPFailure', 82, 'medium', 'retry_after_fix'),
  (11, 'UnexpectedException', 75, 'high', 'retry_with_backoff'), (12, 'Unknown', 30, 'medium', 'retry_with_backoff')),
f AS (SELECT event_id, failure, CAST(confidence AS INTEGER) AS confidence, risk, CASE WHEN event_id % 4 >= 3 THEN 'do_not_retry' ELSE advice END AS retry FROM events JOIN a ON i = event_id % 13)"""


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % len(_MESSAGES)).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", failures.classify(message, F.col("event_id") % 4, F.lit(3)).alias("c"))
    return e.select("event_id", "c.*")


@query(FAILED_SQL + " SELECT * FROM f")
def failure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed(spark, sf_dir)


@query(FAILED_SQL + " SELECT 'class' AS kind, failure AS value, count(*) AS n FROM f GROUP BY failure UNION ALL SELECT 'risk', risk, count(*) FROM f GROUP BY risk")
def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.report(failed(spark, sf_dir))


@query(FAILED_SQL + """ SELECT count(*) AS jobs, count(*) FILTER (WHERE retry = 'retry_immediately') AS retry_immediately, count(*) FILTER (WHERE retry = 'retry_with_backoff') AS retry_with_backoff,
  count(*) FILTER (WHERE retry = 'retry_after_fix') AS retry_after_fix, count(*) FILTER (WHERE retry = 'do_not_retry') AS do_not_retry FROM f""")
def retry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.retry_report(failed(spark, sf_dir))
