"""Queries over state machines: pipelines, manifests and their nodes.

The events of a user are the triggers of a machine; the tables hold no triggers, so an event's
trigger follows from its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import machines
from quern.registry import query
from quern.sources.tables import table

#: Triggers in the order in which they take a pipeline to its end, now and then with others.
TRIGGERS = tuple(t for _, t, _ in machines.PIPELINE_STEPS)
ORDERED = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _rows(table_: machines.Table) -> str:
    return ", ".join(f"('{a}', '{t}', '{b}')" for a, t, b in table_)


def _walk_sql(events: str, table_: machines.Table, start: str) -> str:
    """The machine as a fold over each user's triggers."""
    return f"""
WITH RECURSIVE t(a, k, b) AS (VALUES {_rows(table_)}), e AS ({events}),
w AS (SELECT user_id, event_id, i, k, '{start}' AS before, coalesce((SELECT b FROM t WHERE t.a = '{start}' AND t.k = e.k), '{start}') AS after, EXISTS (SELECT 1 FROM t WHERE t.a = '{start}' AND t.k = e.k) AS legal FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, e.k, w.after, coalesce(t.b, w.after), t.b IS NOT NULL FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1 LEFT JOIN t ON t.a = w.after AND t.k = e.k)
"""


#: Which trigger an event is: the next of the row for most, so that machines get on; by number.
_PLACE_SQL = f"CASE WHEN event_id % 7 = 0 THEN 'ERROR' WHEN event_id % 11 = 0 THEN 'RETRY' WHEN event_id % 29 = 0 THEN 'CANCEL' ELSE {list(TRIGGERS)}[(i - 1) % {len(TRIGGERS)} + 1] END"
PIPELINE_SQL = _walk_sql(f"SELECT *, {_PLACE_SQL} AS k FROM (SELECT user_id, event_id, {ORDERED} AS i FROM events)", machines.pipeline_table(), "QUEUED")


def _triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").withColumn("i", i)
    trigger = F.when(n % 7 == 0, "ERROR").when(n % 11 == 0, "RETRY").when(n % 29 == 0, "CANCEL").otherwise(machines.trigger_of(F.col("i"), TRIGGERS))
    return e.select(F.col("user_id").alias("machine"), "ts", "event_id", trigger.alias("trigger"))


@query(PIPELINE_SQL + "SELECT user_id AS machine, event_id, k AS trigger, before, after, legal FROM w")
def pipeline_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a pipeline with the state it met and the one it led to."""
    walked = machines.run(_triggers(spark, sf_dir), machines.pipeline_table(), "QUEUED")
    return walked.select("machine", "event_id", "trigger", "before", "after", "legal")


@query(PIPELINE_SQL + f"""SELECT user_id AS machine, arg_max(after, i) AS state, arg_max(before, i) FILTER (WHERE legal AND before NOT IN {machines.PIPELINE_ENDS}) AS checkpoint,
  count(*) FILTER (WHERE legal) AS moves, count(*) FILTER (WHERE NOT legal) AS refused, arg_max(after, i) IN {machines.PIPELINE_ENDS} AS ended FROM w GROUP BY user_id""")
def pipeline_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each pipeline stands and what it would be retried from."""
    return machines.settled(machines.run(_triggers(spark, sf_dir), machines.pipeline_table(), "QUEUED"), machines.PIPELINE_ENDS)


_NODES, _MANIFESTS = tuple(machines.NODE), tuple(machines.MANIFEST)


@query(_walk_sql(f"SELECT user_id, event_id, {ORDERED} AS i, {list(_NODES)}[least(event_id % 9, 6) + 1] AS k FROM events", machines.monotone_table(machines.NODE), "discovered")
       + "SELECT before, k AS trigger, legal, count(*) AS n FROM w GROUP BY ALL")
def node_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statuses nodes were set to from which, and whether they might: never back, and
    never on from the end."""
    e = table(spark, sf_dir, "events")
    status = machines.trigger_of(F.least(F.col("event_id") % 9, F.lit(6)), _NODES)
    walked = machines.run(e.select(F.col("user_id").alias("machine"), "ts", "event_id", status.alias("trigger")), machines.monotone_table(machines.NODE), "discovered")
    return walked.groupBy("before", "trigger", "legal").agg(F.count(F.lit(1)).alias("n"))


@query(_walk_sql(f"SELECT user_id, event_id, i, CASE WHEN event_id % 40 = 0 THEN 'error' ELSE {list(_MANIFESTS)}[i % 6 + 1] END AS k FROM (SELECT user_id, event_id, {ORDERED} AS i FROM events)", machines.status_table(machines.MANIFEST), "initializing")
       + "SELECT before, k AS trigger, legal, count(*) AS n FROM w GROUP BY ALL")
def manifest_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of manifests, whose statuses follow one another."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("i", i)
    status = F.when(F.col("event_id") % 40 == 0, "error").otherwise(machines.trigger_of(F.col("i") % 6, _MANIFESTS))
    walked = machines.run(e.select(F.col("user_id").alias("machine"), "ts", "event_id", status.alias("trigger")), machines.status_table(machines.MANIFEST), "initializing")
    return walked.groupBy("before", "trigger", "legal").agg(F.count(F.lit(1)).alias("n"))
