"""State machines over a stream of events, by a stateful processor with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.operators.machines import Table, _steps, walk

#: What the session needs: the processor's state lives in this store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "machine long, event_id long, trigger string, before string, after string, legal boolean"


class _Machine(StatefulProcessor):
    def __init__(self, table: Table, start: str):
        self.steps, self.start = _steps(table), start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "name string")
        self.waiting = handle.getListState("waiting", "micros long, event_id long, trigger string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Events wait until the watermark has passed them; those that it has already are late."""
        due = max(timerValues.getCurrentWatermarkInMs(), 0)
        due_micros, new = due * 1000, []
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            new += [(int(t), int(i), k) for t, i, k in zip(micros, part["event_id"], part["trigger"], strict=True) if t >= due_micros]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(due, min(t for t, _, _ in new) // 1000) + 1)
        yield pd.DataFrame(columns=[c.split()[0] for c in _OUT.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        ready = [w for w in waiting if w[0] < due * 1000]
        rest = waiting[len(ready) :]
        state = self.state.get()[0] if self.state.exists() else self.start
        told = walk(self.steps, state, [k for _, _, k in ready])
        if told:
            self.state.update((told[-1][1],))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(due, rest[0][0] // 1000) + 1)
        else:
            self.waiting.clear()
        rows = [(key[0], i, k, *step) for (_, i, k), step in zip(ready, told, strict=True)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, table: Table, start: str, late: str = "2 hours") -> DataFrame:
    """The stream form of :func:`quern.operators.machines.run` over (machine long, ts timestamp,
    event_id long, trigger): each event, once the watermark (``late`` behind the newest event)
    has passed it, with before, after and legal.

    Events that come later than that, or without machine or time, are left out; an event that
    repeats within ``late`` counts once. The state of a machine is its name and the events
    that wait; names are kept for good, as a machine may go on at any time. The session
    must name the state store in PROVIDER.
    """
    once = events.filter("machine is not null and ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["machine", "event_id"])
    rows = once.select("machine", "ts", "event_id", F.col("trigger"))
    return rows.groupBy("machine").transformWithStateInPandas(_Machine(table, start), _OUT, "append", "EventTime")
