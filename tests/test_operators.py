import datetime
import math
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.catalog import QUERIES
from quern.functions import text, urls
from quern.operators import diff, failures, graph, ordered, rules
from quern.sources import tables
from quern.streaming import events


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


def test_urls(spark):
    cases = {
        " HTTPS://A.com/B/?utm_source=x&q=1#f ": "https://a.com/B?q=1",
        "http://a.com": "http://a.com/",
        "not a URL#x": "not a url",
        "http://a.com/?ref=1": "http://a.com/",
    }
    for url, want in cases.items():
        assert one(spark, url, urls.normalize) == want
    assert one(spark, None, urls.normalize) is None
    pages = {"http://a/x?page=4&p=2": 4, "http://a/page/7/": 7, "http://a/b/12": 12, "http://a/b": 1}
    for url, want in pages.items():
        assert one(spark, url, urls.page_number) == want
    skips = {"mailto:a@b.c": "protocol", "/x": "protocol", "http://b.com:8080/": "external", "http://u:p@a.com:81/x.pdf": "extension", "http://a.com/x.PDF": "extension", "http://a.com/cart": "path"}
    for url, want in skips.items():
        assert one(spark, url, lambda c: urls.skip_reason(c, F.lit("a.com"))) == want
    assert one(spark, "http://a.com/x", lambda c: urls.skip_reason(c, F.lit("a.com"))) is None


def test_text_and_colours(spark):
    assert one(spark, -2.5, text.js_round, "double") == -2
    assert one(spark, "some-slugName", text.humanize) == "Some Slug Name"
    assert tuple(one(spark, "#0f8", text.rgb)) == (0, 255, 136)
    assert one(spark, None, lambda c: text.letter_grade(c, "qa"), "double") == "UNKNOWN"
    assert [one(spark, s, lambda c: text.letter_grade(c, "qa"), "double") for s in (95.0, 94.9, 49.0)] == ["A+", "A", "F"]


def test_diff_of_empty_and_null(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "k string, h string")
    b = spark.createDataFrame([("x", "2"), ("y", None), ("n", "4")], "k string, h string")
    assert dict(diff.manifest_diff(a, b, "k", "h").collect()) == {"x": "changed", "y": "unchanged", "z": "deleted", "n": "new"}
    s = diff.diff_summary(diff.manifest_diff(a.limit(0), b.limit(0), "k", "h")).first()
    assert (s["new"], s["skip_rate"]) == (0, 0.0)


def test_ranked_total_agrees_with_one_window(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 97).cast("double").alias("v"), "id")
    got = [(r["rank"], r["id"], r["cumulative"]) for r in ordered.ranked_total(df, "v", [F.col("id")], F.col("id"), range_rows=70).orderBy("rank").collect()]
    total, want = 0, []
    for i, (_, k) in enumerate(sorted(((k * 7919) % 97, k) for k in range(500))):
        total += k
        want.append((i + 1, k, total))
    assert got == want
    assert ordered.ranked_total(df.limit(0), "v", [], F.col("id")).collect() == []


def test_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert dict(graph.levels(edges, roots).collect()) == {"a": 0, "b": 1, "c": 2, "d": 2}
    nodes = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "b")], "node string, parent string")
    assert {r.node: r.trail for r in graph.ancestors(nodes).collect()}["d"] == ["b", "a", "c"]


def test_rules(spark):
    table = (("n", 2, "low", "wait", ("time", "out")), ("a", 4, "low", "wait", ("login",)))
    assert one(spark, "timeout login", lambda c: failures.classify(c, F.lit(0), F.lit(1), table)["failure"]) == "n"
    assert tuple(one(spark, None, lambda c: failures.classify(c, F.lit(1), F.lit(1)))) == ("Unknown", 30, "medium", "do_not_retry")
    assert [one(spark, d, lambda c: rules.gate(c, 10), "double") for d in (None, 0.0, -4.9, -5.0, -5.01)] == ["SKIP", "PASS", "WARN", "WARN", "FAIL"]


def test_upsert_and_sitemap(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert dict(tables.upsert(a, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k").collect()) == {1: "a", 2: "c", 3: "d"}
    xml = spark.createDataFrame([("<urlset><url><loc> http://a/ </loc></url><url><loc>http://b/</loc></url></urlset>",)], "xml string")
    assert {r.url for r in tables.sitemap_urls(xml).collect()} == {"http://a/", "http://b/"}


def run_stream(spark, tmp_path, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"))
    hours = run_stream(spark, tmp_path, events.hourly(stream), "hours", "complete").agg(F.sum("n"), F.sum("total")).first()
    assert hours[0] == batch.count() and math.isclose(hours[1], batch.agg(F.sum("value")).first()[0])
    twice = events.deduplicated(stream.unionAll(stream))
    assert run_stream(spark, tmp_path, twice, "once", "append").count() == batch.count()
    rows = run_stream(spark, tmp_path, events.sessions(stream), "open", "append").collect()
    ended = {(r.user_id, r.n) for r in rows}
    assert ended and ended <= {(r.user_id, r.n) for r in QUERIES["sessions"](spark, "/root/testdata/sf0.001").collect()}
    assert run_stream(spark, tmp_path, events.envelope(stream), "wrapped", "append").count() == batch.count()


def test_transitions_follow_event_time_across_batches(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # Each file is a micro-batch; within an hour, events of odd ids come a file later.
    hour = F.floor(F.unix_timestamp("ts") / 200_000) + F.when(F.col("event_id") % 2 == 1, 1).otherwise(0)
    parts = batch.withColumn("part", hour)
    numbers = sorted(r.part for r in parts.select("part").distinct().collect())
    for n in numbers:
        parts.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    end = batch.limit(1).withColumns({"ts": F.timestamp_micros(F.lit(4_000_000_000_000_000)), "user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long")})
    for _ in range(2):
        end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), max_files=1)
    wrong = run_stream(spark, tmp_path, events.transitions(stream, late="30 days"), "wrong", "append")
    w = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    want = batch.withColumn("before", w).filter(~events.legal(F.col("before"), F.col("event_type"))).select("user_id", "event_id", "before", "event_type")
    assert sorted(map(tuple, wrong.collect())) == sorted(map(tuple, want.collect()))


def test_the_report_holds_the_newest_events(spark, tmp_path):
    for a, b in ((0, 3), (3, 5)):
        rows = [(i, datetime.datetime(2026, 1, 1, i), 1, "view", 1.0, None) for i in range(a, b)]
        spark.createDataFrame(rows, events.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = events.read_events(spark, str(tmp_path / "in"), max_files=1).writeStream.foreachBatch(events.report_sink(str(tmp_path / "report"), keep=3))
    q = q.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(r.event_id for r in spark.read.json(str(tmp_path / "report" / "1")).collect()) == [2, 3, 4]


def test_levels_of_a_chain(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(8)], "child string, parent string")
    assert {r.node: r.depth for r in graph.longest_levels(chain).collect()} == {f"n{i}": i for i in range(9)}


def test_an_upsert_without_an_order_keeps_one_row_a_key(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (2, "d"), (2, "d"), (None, "m")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(a, b, "k").collect()), key=str) == [(1, "a"), (2, "d"), (None, "m")]


def test_a_failure_is_told_by_its_stack_too(spark):
    message, stack = F.lit("it broke"), F.lit("at TypeError: x is not a function")
    df = spark.range(1).select(failures.classify(message, F.lit(0), F.lit(3)).alias("a"), failures.classify(message, F.lit(0), F.lit(3), stack=stack).alias("b"), failures.classify(F.lit(None).cast("string"), F.lit(0), F.lit(3), stack=stack).alias("c"))
    r = df.first()
    assert (r.a.failure, r.b.failure, r.c.failure) == ("Unknown", "UnexpectedException", "UnexpectedException")
