"""Streaming forms of the event queries: watermarks, windows, sessions, state.

Every function takes a streaming (or batch) DataFrame of events and returns a DataFrame;
sources and sinks are the caller's. State is bounded by the watermark, except where keys
are jobs, which :func:`transitions` drops when they end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.functions import media

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hours: (hour, event_type, n, total)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def envelope(events: DataFrame) -> DataFrame:
    """Events of a pipeline in the common form: (event_id, timestamp, job, subsystem, event,
    severity, payload). A plain projection, for streams and tables alike."""
    kind = F.col("event_type")
    return events.select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").alias("job"), media.event_subsystem(kind).alias("subsystem"), kind.alias("event"),
        media.event_severity(kind).alias("severity"), F.col("props").alias("payload"),
    )


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once, as long as its copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


#: Which event may follow which for a user; all others are illegal.
NEXT = {"signup": ("view", "click"), "view": ("view", "click", "error"), "click": ("view", "click", "purchase", "error"), "purchase": ("view", "signup"), "error": ("view", "signup")}


def legal(before: Column, now: Column) -> Column:
    allowed = F.create_map(*(F.lit(f"{a}>{b}") if i == 0 else F.lit(True) for a, bs in NEXT.items() for b in bs for i in (0, 1)))
    return before.isNull() | F.coalesce(F.try_element_at(allowed, F.concat_ws(">", before, now)), F.lit(False))


#: A user's last event is forgotten after so many milliseconds of event time without another.
FORGET_MS = 24 * 3600 * 1000


def _step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Holds events back until the watermark passes them, then takes them in order of time."""
    last, waiting = None, []
    if state.exists:
        last, times, ids, kinds = state.get
        waiting = list(zip(times, ids, kinds, strict=True))
    due = state.getCurrentWatermarkMs()
    if not state.hasTimedOut:
        for rows in frames:
            micros = rows["ts"].astype("datetime64[us]").astype("int64")
            waiting += [(int(t), int(i), k) for t, i, k in zip(micros, rows["event_id"], rows["event_type"], strict=True) if t >= due * 1000]
    waiting.sort()
    ready = [w for w in waiting if w[0] < due * 1000]
    waiting = waiting[len(ready) :]
    wrong = []
    for _, event_id, kind in ready:
        if last is not None and kind not in NEXT.get(last, ()):
            wrong.append((key[0], event_id, last, kind))
        last = kind
    if state.hasTimedOut and not ready and not waiting:
        state.remove()
    else:
        state.update((last, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
        state.setTimeoutTimestamp(waiting[0][0] // 1000 + 1 if waiting else due + FORGET_MS)
    yield pd.DataFrame(wrong, columns=["user_id", "event_id", "before", "event_type"])


def transitions(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Illegal transitions of each user in order of event time, across micro-batches.

    An event waits in the state until the watermark (``late`` behind the newest event) has
    passed it; one that comes later than that is not counted. A user's last event is kept
    for a day of event time. A stream that ends leaves its last ``late`` of events waiting.
    """
    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        _step, "user_id long, event_id long, before string, event_type string", "last string, times array<long>, ids array<long>, kinds array<string>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def report_sink(folder: str, keep: int = 1000):
    """For ``foreachBatch``: keeps the newest ``keep`` events of the stream as one JSON report in
    ``folder``/n, n the batch, written anew with each; a batch that is tried again writes the same."""

    def write(batch: DataFrame, n: int) -> None:
        newest = batch
        try:
            newest = batch.unionByName(batch.sparkSession.read.schema(batch.schema).json(f"{folder}/{n - 1}"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        newest.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep).coalesce(1).write.mode("overwrite").json(f"{folder}/{n}")

    return write
