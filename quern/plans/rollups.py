"""Roll-ups that monitor runs: stages, dashboards, checks, deployments. Events, orders and lines
stand in for snapshots, jobs and deployments."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import ordered, stats
from quern.registry import query
from quern.scratch import materialize, shared_dir
from quern.sources import checkpoints
from quern.sources.tables import table

SNAP_SQL = "WITH s AS (SELECT event_id, user_id, ts, event_type AS stage, value, event_id % 101 AS coverage, (event_id * 7) % 101 AS assets, (event_id * 13) % 101 AS effect, (event_id * 29) % 101 AS fidelity FROM events)"
DIMENSIONS = ("fidelity", "coverage", "assets", "effect")
#: Averages below the first warn, below the second are critical.
THRESHOLDS = {"fidelity": (60, 40), "coverage": (80, 60), "assets": (85, 70), "effect": (40, 0)}
#: Weights of the dimensions in each stage's score.
STAGE_WEIGHTS = {
    "SCRAPE": {"coverage": 0.5, "assets": 0.5},
    "MANIFEST": {"coverage": 0.7, "assets": 0.3},
    "DIFFERENTIAL_INTELLIGENCE": {"fidelity": 0.6, "effect": 0.4},
    "VISUAL_DNA": {"fidelity": 0.8, "assets": 0.2},
    "VISUAL_RECONSTRUCTION": {"fidelity": 0.7, "effect": 0.3},
    "WEBSITE_PRIME": {"fidelity": 0.6, "coverage": 0.3, "assets": 0.1},
    "BACKEND_MERGE": {"coverage": 0.5, "assets": 0.5},
    "DEPLOYMENT": {"coverage": 0.4, "assets": 0.4, "effect": 0.2},
}


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quality snapshots; the figures follow from their numbers."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.col("event_type").alias("stage"), "value", (i % 101).alias("coverage"), (i * 7 % 101).alias("assets"), (i * 13 % 101).alias("effect"), (i * 29 % 101).alias("fidelity")
    )


@query(SNAP_SQL + """, d AS (UNPIVOT (SELECT fidelity, coverage, assets, effect FROM s) ON fidelity, coverage, assets, effect INTO NAME dimension VALUE v), t(dimension, warn, crit) AS (VALUES ('fidelity', 60, 40), ('coverage', 80, 60), ('assets', 85, 70), ('effect', 40, 0)),
g AS (SELECT dimension, round(avg(v), 2) AS mean, min(v) AS least, max(v) AS most, max(warn) AS warn, max(crit) AS crit FROM d JOIN t USING (dimension) GROUP BY dimension)
SELECT dimension, mean, least, most, CASE WHEN mean < crit THEN 'CRITICAL' WHEN mean < warn THEN 'WARN' ELSE 'HEALTHY' END AS status FROM g""")
def quality_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least, most and status of each dimension over all snapshots, in one pass."""
    s = snapshots(spark, sf_dir)
    one = s.agg(*(f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))))

    def row(c: str) -> Column:
        mean = F.round(F.col(f"mean_{c}"), 2)
        warn, crit = THRESHOLDS[c]
        status = F.when(mean < crit, "CRITICAL").when(mean < warn, "WARN").otherwise("HEALTHY")
        return F.struct(F.lit(c).alias("dimension"), mean.alias("mean"), F.col(f"least_{c}").alias("least"), F.col(f"most_{c}").alias("most"), status.alias("status"))

    return one.select(F.explode(F.array(*map(row, DIMENSIONS))).alias("r")).select("r.*")


@query(SNAP_SQL + " SELECT user_id, count(*) AS snapshots, arg_max(fidelity, (ts, event_id)) AS latest_fidelity, arg_max(coverage, (ts, event_id)) AS latest_coverage, count(*) FILTER (WHERE fidelity < 40) AS alerts FROM s GROUP BY user_id")
def job_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest figures of each job and how often fidelity was critical."""
    last = F.struct("ts", "event_id")
    return snapshots(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("snapshots"), F.max_by("fidelity", last).alias("latest_fidelity"), F.max_by("coverage", last).alias("latest_coverage"), F.count_if(F.col("fidelity") < 40).alias("alerts")
    )


@query(SNAP_SQL + " SELECT stage, count(*) AS n, round(avg(fidelity), 6) AS quality, round(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE coverage END) / count(*)::DOUBLE, 6) AS duration FROM s GROUP BY stage")
def stage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality and duration of each stage; a missing duration counts as none."""
    duration = F.when(F.col("event_id") % 3 != 0, F.col("coverage"))
    return snapshots(spark, sf_dir).groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fidelity"), 6).alias("quality"), F.round(F.avg(F.coalesce(duration, F.lit(0))), 6).alias("duration")
    )


_STAGES = tuple(STAGE_WEIGHTS)


@query(SNAP_SQL + """ SELECT event_id, floor(least(100, greatest(0, CASE event_id % 8 WHEN 0 THEN coverage * 0.5::DOUBLE + assets * 0.5::DOUBLE WHEN 1 THEN coverage * 0.7::DOUBLE + assets * 0.3::DOUBLE WHEN 2 THEN fidelity * 0.6::DOUBLE + effect * 0.4::DOUBLE
  WHEN 3 THEN fidelity * 0.8::DOUBLE + assets * 0.2::DOUBLE WHEN 4 THEN fidelity * 0.7::DOUBLE + effect * 0.3::DOUBLE WHEN 5 THEN fidelity * 0.6::DOUBLE + coverage * 0.3::DOUBLE + assets * 0.1::DOUBLE WHEN 6 THEN coverage * 0.5::DOUBLE + assets * 0.5::DOUBLE
  ELSE coverage * 0.4::DOUBLE + assets * 0.4::DOUBLE + effect * 0.2::DOUBLE END)) * 10 + 0.5) / 10 AS score FROM s""")
def stage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot's score by the weights of its stage."""
    score = F.lit(None).cast("double")
    for i, weights in enumerate(STAGE_WEIGHTS.values()):
        total = sum((F.col(c) * w for c, w in list(weights.items())[1:]), F.col(next(iter(weights))) * next(iter(weights.values())))
        score = F.when(F.col("event_id") % 8 == i, total).otherwise(score)
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))
    return snapshots(spark, sf_dir).select("event_id", (F.floor(clamped * 10 + 0.5) / 10).alias("score"))


@query("""
WITH l AS (SELECT event_type AS route, value * 100 AS ms, value < 60 AS ok FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ms) AS i, count(*) OVER (PARTITION BY route) AS n FROM l),
g AS (SELECT route, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS mean_ms, max(ms) FILTER (WHERE i = greatest(ceil(n * 0.95::DOUBLE), 1)) AS p95_ms FROM r GROUP BY route)
SELECT *, CASE WHEN failed >= ceil((passed + failed) / 2.0) OR p95_ms > 8000 THEN 'fail' WHEN failed > 0 OR p95_ms > 3000 THEN 'warn' ELSE 'pass' END AS status FROM g
""")
def route_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of each route (event type): passed, failed, mean and 95th percentile, and the status."""
    probes = table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_type").alias("route"), (F.col("value") * 100).alias("ms"), (F.col("value") < 60).alias("ok"))
    g = probes.groupBy("route").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.floor(F.avg("ms") + 0.5).cast("long").alias("mean_ms"))
    p95 = ordered.at_ranks(probes, "route", "ms", {"p95_ms": stats.nearest_rank(0.95)}).drop("n")
    out = g.join(p95, "route")
    late, half = F.col("p95_ms"), F.ceil((F.col("passed") + F.col("failed")) / 2)
    status = F.when((F.col("failed") >= half) | (late > 8000), "fail").when((F.col("failed") > 0) | (late > 3000), "warn").otherwise("pass")
    return out.withColumn("status", status)


DEPLOY_SQL = "WITH d AS (SELECT o_orderkey, o_custkey, o_orderdate, ['completed', 'failed', 'running', 'rolled_back'][o_orderkey % 4 + 1] AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 1000 END AS ms FROM orders)"


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("completed", "failed", "running", "rolled_back"))), (k % 4).cast("int"))
    return table(spark, sf_dir, "orders").select(k, "o_custkey", "o_orderdate", status.alias("status"), F.when(k % 5 > 0, k % 1000).alias("ms"))


@query(DEPLOY_SQL + " SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'rolled_back') AS rolled_back, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS mean_ms, min(o_orderkey) AS first_run, max(o_orderkey) AS last_run FROM d")
def deployment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return deployments(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("runs"), *(F.count_if(s == n).alias(n) for n in ("completed", "failed", "rolled_back")), F.floor(F.avg("ms") + 0.5).cast("long").alias("mean_ms"),
        F.min("o_orderkey").alias("first_run"), F.max("o_orderkey").alias("last_run"),
    )


@query(DEPLOY_SQL + """, g AS (SELECT o_custkey % 20 AS env, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running, max(o_orderkey) FILTER (WHERE status = 'completed') AS latest FROM d GROUP BY 1)
SELECT env, total, CASE WHEN ok + failed = 0 THEN 100.0 ELSE floor(ok * 1000.0::DOUBLE / (ok + failed) + 0.5) / 10 END AS success_rate, latest, CASE WHEN total > 0 AND failed = total THEN 'critical' WHEN failed > ok OR running > 2 THEN 'degraded' ELSE 'healthy' END AS health FROM g""")
def deployment_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of each environment by its deployments."""
    s = F.col("status")
    g = deployments(spark, sf_dir).groupBy((F.col("o_custkey") % 20).alias("env")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("ok"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "running").alias("running"),
        F.max(F.when(s == "completed", F.col("o_orderkey"))).alias("latest"),
    )
    ended = F.col("ok") + F.col("failed")
    rate = F.when(ended == 0, 100.0).otherwise(F.floor(F.try_divide(F.col("ok") * 1000.0, ended) + 0.5) / 10)
    health = F.when(F.col("failed") == F.col("total"), "critical").when((F.col("failed") > F.col("ok")) | (F.col("running") > 2), "degraded").otherwise("healthy")
    return g.select("env", "total", rate.alias("success_rate"), "latest", health.alias("health"))


@query(DEPLOY_SQL + " SELECT status, count(*) AS n, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS mean_ms, strftime(max(o_orderdate), '%Y-%m-%d') AS last_update FROM d GROUP BY status")
def deployment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deployments(spark, sf_dir).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.avg("ms") + 0.5).cast("long").alias("mean_ms"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_update")
    )


MANIFEST_SQL = "WITH m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '0.9' ELSE '1.0' END AS version, coalesce(source, 'none') AS origin, doc_id % 30 AS age FROM documents)"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    version = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "0.9").otherwise("1.0")
    return table(spark, sf_dir, "documents").select("doc_id", version.alias("version"), F.coalesce("source", F.lit("none")).alias("origin"), (k % 30).alias("age"))


@query(MANIFEST_SQL + " SELECT count(*) AS snapshots, count(DISTINCT version) AS versions, count(DISTINCT origin) AS origins, arg_max(doc_id, (-age, doc_id)) AS latest, count(*) FILTER (WHERE age > 7) AS stale, count(*) FILTER (WHERE version IS NULL OR version <> '1.0') AS anomalies FROM m")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All manifests at once: versions, origins, the latest, stale ones and those of another schema."""
    return manifests(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("snapshots"), F.countDistinct("version").alias("versions"), F.countDistinct("origin").alias("origins"), F.max_by("doc_id", F.struct(-F.col("age"), "doc_id")).alias("latest"),
        F.count_if(F.col("age") > 7).alias("stale"), F.count_if(F.col("version").isNull() | (F.col("version") != "1.0")).alias("anomalies"),
    )


@query(MANIFEST_SQL + " SELECT coalesce(version, '-') AS version, count(*) AS n FROM m GROUP BY 1")
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests(spark, sf_dir).groupBy(F.coalesce("version", F.lit("-")).alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query(MANIFEST_SQL + " SELECT doc_id, version FROM m WHERE version IS NULL OR version NOT IN ('1.0') ORDER BY doc_id LIMIT 20")
def schema_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report of manifests without a known schema."""
    return manifests(spark, sf_dir).filter(F.col("version").isNull() | ~F.col("version").isin("1.0")).orderBy("doc_id").limit(20).select("doc_id", "version")


@query(MANIFEST_SQL + " SELECT origin, arg_max(doc_id, (-age, doc_id)) AS baseline FROM m WHERE version = '1.0' GROUP BY origin")
def latest_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest manifest of each origin that a new crawl can be compared with."""
    return manifests(spark, sf_dir).filter("version = '1.0'").groupBy("origin").agg(F.max_by("doc_id", F.struct(-F.col("age"), "doc_id")).alias("baseline"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-50 report: the newest jobs."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job by its key; the filter reaches the scan."""
    return table(spark, sf_dir, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_custkey, o_orderdate FROM orders),
x AS (SELECT *, lag(i) OVER w AS was, epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER w) AS us FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CASE WHEN us > 0 THEN round((i - was) / (us / 86400000000.0::DOUBLE), 6) ELSE 0.0 END AS per_day FROM x
""")
def progress_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each job since the sample before, a day; none without time between."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("i"), "o_custkey", "o_orderdate", F.lag("o_orderdate").over(w).alias("before"))
    us = F.expr("timestampdiff(MICROSECOND, before, o_orderdate)")
    return x.select("o_orderkey", F.when(us > 0, F.round(F.lit(1) / (us / 86400000000.0), 6)).otherwise(0.0).alias("per_day"))


@query("""
WITH s(stage, needs) AS (VALUES ('scrape', ''), ('manifest', 'scrape'), ('diff', 'manifest'), ('dna', 'manifest'), ('build', 'dna'), ('merge', 'build'), ('deploy', 'merge'), ('monitor', 'deploy')), n AS (SELECT count(*) AS k FROM region)
SELECT stage, CAST(CASE stage WHEN 'scrape' THEN 0 WHEN 'manifest' THEN 1 WHEN 'diff' THEN 2 WHEN 'dna' THEN 2 WHEN 'build' THEN 3 WHEN 'merge' THEN 4 WHEN 'deploy' THEN 5 ELSE 6 END AS INTEGER) AS depth FROM s WHERE (SELECT k FROM n) > 0
""")
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a pipeline in an order in which none comes before those it needs: the longest
    way to each, level by level."""
    from quern.operators.graph import longest_levels

    needs = spark.createDataFrame(
        [("manifest", "scrape"), ("diff", "manifest"), ("dna", "manifest"), ("build", "dna"), ("build", "manifest"), ("merge", "build"), ("merge", "diff"), ("deploy", "merge"), ("monitor", "deploy")],
        "child string, parent string",
    )
    return longest_levels(needs).withColumnRenamed("node", "stage")


@query("""
WITH e AS (SELECT 'k' || user_id % 7 AS job, 'u' || event_id % 40 AS url, ts, event_id FROM events)
SELECT job, url, min(event_id) AS first_event FROM e GROUP BY 1, 2
""")
def completed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each URL of a job once, by the first event that completes it, however often it is marked."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string")).alias("job"), F.concat(F.lit("u"), (F.col("event_id") % 40).cast("string")).alias("url"), "event_id")
    return e.groupBy("job", "url").agg(F.min("event_id").alias("first_event"))


@query(SNAP_SQL + """, d AS (UNPIVOT (SELECT event_id, fidelity, coverage, assets, effect FROM s) ON fidelity, coverage, assets, effect INTO NAME dimension VALUE v), t(dimension, warn, crit) AS (VALUES ('fidelity', 60, 40), ('coverage', 80, 60), ('assets', 85, 70), ('effect', 40, 0))
SELECT event_id, dimension, CASE WHEN v < crit THEN 'CRITICAL' ELSE 'WARN' END AS severity FROM d JOIN t USING (dimension) WHERE v < warn""")
def dimension_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of each snapshot for every dimension below its thresholds; higher is better."""
    long = snapshots(spark, sf_dir).unpivot("event_id", list(DIMENSIONS), "dimension", "v")
    limit = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for k, t in THRESHOLDS.items() for x in (k, t[i]))), F.col("dimension"))
    return long.filter(F.col("v") < limit(0)).select("event_id", "dimension", F.when(F.col("v") < limit(1), "CRITICAL").otherwise("WARN").alias("severity"))


@query("""
WITH r AS (SELECT s_suppkey AS id, ['immediate', 'urgent', 'planned', 'optional'][s_suppkey % 4 + 1] AS urgency, s_suppkey % 4 AS rank FROM supplier) SELECT id, urgency, CAST(row_number() OVER (ORDER BY rank, id) AS BIGINT) AS place FROM r
""")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs (suppliers) in order of urgency, ranked in ranges."""
    k = F.col("s_suppkey")
    urgency = F.get(F.array(*map(F.lit, ("immediate", "urgent", "planned", "optional"))), (k % 4).cast("int"))
    r = table(spark, sf_dir, "supplier").select(k.alias("id"), urgency.alias("urgency"), (k % 4).cast("double").alias("rank_"))
    return ordered.ranked_total(r, "rank_", [F.col("id")], F.lit(1)).select("id", "urgency", F.col("rank").alias("place"))


@query("""
WITH s AS (SELECT user_id AS job, event_id, v FROM events, (VALUES (1), (2), (3)) AS t(v) WHERE event_id % 3 < v),
g AS (SELECT job, v, count(*) AS done, max(event_id) AS newest, count(*) FILTER (WHERE event_id % 2 = 1) AS lost FROM s GROUP BY job, v)
SELECT job, CAST(v AS BIGINT) AS version, done, newest FROM g WHERE v < 3 OR job % 5 > 0 OR lost = 0 QUALIFY row_number() OVER (PARTITION BY job ORDER BY v DESC) = 1
""")
def restored_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three checkpoints of the events that users (jobs) have done give back, where the
    third was torn for every fifth user: it lost rows after its commit had been written."""
    folder = f"{shared_dir(spark)}/quern/checkpoints-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id")
    for n in (1, 2, 3):
        checkpoints.save(e.filter(F.col("event_id") % 3 < n), folder)
    torn = spark.read.schema(e.schema).parquet(f"{folder}/rows/version=3").filter("job % 5 > 0 or event_id % 2 = 0")
    checkpoints.write_rows(materialize(torn, "torn"), folder, 3)
    loaded = checkpoints.load(spark, folder)
    return loaded.groupBy("job", "version").agg(F.count(F.lit(1)).alias("done"), F.max("event_id").alias("newest"))
