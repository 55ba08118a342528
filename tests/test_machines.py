import datetime
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import machines
from quern.streaming.machines import PROVIDER, run_stream

SCHEMA = "machine long, ts timestamp, event_id long, trigger string"
T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def brute(rows, table, start):
    steps, state, out, seen = {(a, t): b for a, t, b in table}, {}, {}, set()
    for m, ts, i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or datetime.datetime.min, r[2])):
        if (m, i) not in seen:
            seen.add((m, i))
            before = state.get(m, start)
            after = steps.get((before, t))
            state[m] = after or before
            out[m, i] = (t, before, state[m], after is not None)
    return out


def random_events(rng, n, users):
    triggers = [t for _, t, _ in machines.pipeline_table()] + [None, "NONSENSE"]
    return [(rng.choice(users), at(rng.randrange(600)), i, rng.choice(triggers)) for i in range(n)]


def test_the_tables_are_as_the_rules_say():
    table = machines.pipeline_table()
    assert len(machines.PIPELINE) == 15 and len(table) == 14 + 24 + 2
    assert {a for a, _, _ in table} == set(machines.PIPELINE) - {"COMPLETE"}
    assert {(b, t) for a, t, b in table if a == "FAILED"} == {("QUEUED", "RETRY")}
    node = {(a, b) for a, b, _ in machines.monotone_table(machines.NODE)}
    assert ("discovered", "parsed") in node and ("parsed", "parsed") in node and ("parsed", "fetched") not in node and ("error", "complete") not in node
    manifest = {(a, b) for a, b, _ in machines.status_table(machines.MANIFEST)}
    assert ("rendering", "partial") in manifest and ("crawling", "media") not in manifest and not any(a == "complete" for a, _ in manifest)
    with pytest.raises(ValueError):
        machines._steps([("a", "t", "b"), ("a", "t", "c")])


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_batch_equals_a_loop_whatever_the_ranges(spark, range_rows):
    rng = random.Random(range_rows)
    rows = random_events(rng, 150, [1, 2, 3, 3, 3, 3, 3, 3])
    path = [t for _, t, _ in machines.PIPELINE_STEPS if t != "DIFF_SKIPPED"]
    rows += [(9, at(i), 1000 + i, t) for i, t in enumerate(path[:12])] + [(None, at(1), 1, "START"), (5, None, 7, "START"), (5, at(0), 3, "CRAWL_STARTED")]
    rows += rows[:20]
    table = machines.pipeline_table()
    df = machines.run(spark.createDataFrame(rows, SCHEMA), table, "QUEUED", range_rows=range_rows)
    assert {(r.machine, r.event_id): (r.trigger, r.before, r.after, r.legal) for r in df.collect()} == brute(rows, table, "QUEUED")
    ends = {r.machine: (r.state, r.checkpoint, r.ended) for r in machines.settled(df, machines.PIPELINE_ENDS).collect()}
    assert ends[9] == ("COMPLETE", "DEPLOYING", True) and ends[5] == ("SCRAPING", "DISCOVERING", False)


def test_no_events(spark):
    assert machines.run(spark.createDataFrame([], SCHEMA), machines.pipeline_table(), "QUEUED").collect() == []


def test_a_stream_equals_the_batch_on_late_and_repeated_events(spark, tmp_path):
    rng = random.Random(4)
    rows = random_events(rng, 240, [1, 2, 3, 4])
    rows.sort(key=lambda r: (r[1] + datetime.timedelta(minutes=rng.randrange(100)), r[2]))  # out of order by less than the watermark waits
    rows += [(0, at(10_000), 9_999, "START"), (0, at(20_000), 9_998, "START")]  # let the watermark pass all others
    for n in range(0, len(rows), 40):
        part = rows[n : n + 40] + rows[max(0, n - 5) : n]  # some once more
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{n:04d}"))
    spark.createDataFrame(rows[:3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/9999"))  # far too late
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = run_stream(stream, machines.pipeline_table(), "QUEUED").writeStream.format("memory").queryName("walked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    got = {(r.machine, r.event_id): (r.trigger, r.before, r.after, r.legal) for r in spark.table("walked").filter(F.col("machine") > 0).collect()}
    assert got == {k: v for k, v in brute(rows, machines.pipeline_table(), "QUEUED").items() if k[0] > 0}
