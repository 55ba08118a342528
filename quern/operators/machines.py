"""State machines whose transitions are rows of a table.

A transition is (state, trigger, next). An event whose trigger has no transition from the
state it meets is refused and changes nothing, so every state depends on all events
before it. As a map from states to states an event can be joined with the next one, so
events are cut into ranges, each range is walked from every state at once, and the maps of
the ranges that a machine crosses say in which state each of its ranges begins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.ordered import ranged

Table = list[tuple[str, str, str]]

#: The states of a pipeline in order, and those that end it.
PIPELINE = (
    "QUEUED", "DISCOVERING", "SCRAPING", "MANIFESTING", "DIFFING", "INTELLIGENCE", "VISUAL_RECONSTRUCTION", "STENCIL_GENERATION", "SITE_GENERATION", "MERGING",
    "DEPLOYMENT_PLANNING", "DEPLOYING", "COMPLETE", "FAILED", "ROLLED_BACK",
)
PIPELINE_ENDS = ("COMPLETE", "FAILED", "ROLLED_BACK")
#: What takes a pipeline on from which state to which.
PIPELINE_STEPS = (
    ("QUEUED", "START", "DISCOVERING"), ("DISCOVERING", "CRAWL_STARTED", "SCRAPING"), ("SCRAPING", "CRAWL_DONE", "MANIFESTING"), ("MANIFESTING", "MANIFEST_DONE", "DIFFING"),
    ("DIFFING", "DIFF_DONE", "INTELLIGENCE"), ("MANIFESTING", "DIFF_SKIPPED", "INTELLIGENCE"), ("INTELLIGENCE", "INTELLIGENCE_DONE", "VISUAL_RECONSTRUCTION"),
    ("VISUAL_RECONSTRUCTION", "VISUAL_DONE", "STENCIL_GENERATION"), ("STENCIL_GENERATION", "STENCIL_DONE", "SITE_GENERATION"), ("SITE_GENERATION", "SITE_DONE", "MERGING"),
    ("MERGING", "MERGE_DONE", "DEPLOYMENT_PLANNING"), ("DEPLOYMENT_PLANNING", "PLAN_DONE", "DEPLOYING"), ("DEPLOYING", "DEPLOY_DONE", "COMPLETE"), ("DEPLOYING", "ROLLBACK", "ROLLED_BACK"),
)
#: The statuses of a manifest with those that may follow, and of its nodes with
#: their rank; a node never goes back, and not on from the last rank.
MANIFEST = {
    "initializing": ("crawling", "error"), "crawling": ("scraping", "error"), "scraping": ("media", "error"), "media": ("rendering", "error"),
    "rendering": ("complete", "partial", "error"), "complete": (), "partial": (), "error": (),
}
NODE = {"discovered": 0, "fetched": 1, "parsed": 2, "media_pending": 3, "complete": 4, "error": 4, "skipped": 4}


def pipeline_table() -> Table:
    """The pipeline's transitions: its steps, an error or a cancel from every state that does
    not end it, and a retry from the ends other than success."""
    going = [s for s in PIPELINE if s not in PIPELINE_ENDS]
    return [*PIPELINE_STEPS, *((s, t, "FAILED") for s in going for t in ("ERROR", "CANCEL")), *((s, "RETRY", "QUEUED") for s in ("FAILED", "ROLLED_BACK"))]


def status_table(follows: dict[str, tuple[str, ...]]) -> Table:
    """Transitions of a status that is set to another: the trigger is the status to come."""
    return [(a, b, b) for a, bs in follows.items() for b in bs]


def monotone_table(rank: dict[str, int]) -> Table:
    """Statuses may stay or go on by rank, and those of the last rank never change."""
    last = max(rank.values())
    return [(a, b, b) for a in rank for b in rank if rank[a] < last and rank[b] >= rank[a]]


_STEP = "before string, after string, legal boolean"


def walk(steps: dict[tuple[str, str], str], state: str, triggers: list[str]) -> list[tuple[str, str, bool]]:
    """(before, after, legal) of each trigger in turn."""
    out = []
    for t in triggers:
        after = steps.get((state, t))
        out.append((state, after or state, after is not None))
        state = after or state
    return out


def _steps(table: Table) -> dict[tuple[str, str], str]:
    steps = {(a, t): b for a, t, b in table}
    if len(steps) < len({(*r,) for r in table}):
        raise ValueError("two transitions from one state by one trigger")
    return steps


def run(events: DataFrame, table: Table, start: str, *, range_rows: int = 1 << 18) -> DataFrame:
    """``events`` (machine long, ts, event_id long, trigger) with before, after and legal: every
    machine's events in order of ts, then event_id, from ``start``.

    Events that repeat a (machine, event_id) count once. An event without a machine belongs
    to none and is left out; a null or unknown trigger is refused; a null time comes first.
    A machine's events may fill many ranges: a task holds one, and the driver a row a range.
    """
    steps = _steps(table)
    states = sorted({start, *(s for a, _, b in table for s in (a, b))})
    once = events.filter("machine is not null").dropDuplicates(["machine", "event_id"])
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62)))
    cut = ranged(once.withColumn("_at", at), [F.col("machine"), F.col("_at"), F.col("event_id")], range_rows)
    order = ["machine", "_at", "event_id"]

    def map_of(rows: pd.DataFrame) -> pd.DataFrame:
        """Its first and last machine, and where the last one's events lead from each state."""
        rows = rows.sort_values(order, kind="stable")
        head, tail = int(rows["machine"].iloc[0]), int(rows["machine"].iloc[-1])
        triggers = rows.loc[rows["machine"] == tail, "trigger"].tolist()
        return pd.DataFrame([(int(rows["_range"].iloc[0]), head, tail, [walk(steps, s, triggers)[-1][1] for s in states])], columns=["r", "head", "tail", "leads"])

    maps = cut.groupBy("_range").applyInPandas(map_of, "r int, head long, tail long, leads array<string>").orderBy("r").collect()
    begins: dict[int, str] = {}  # the state in which the first machine of a range goes on
    for a, b in zip(maps, maps[1:]):
        if a.tail == b.head:
            came = begins.get(a.r, start) if a.head == a.tail else start
            begins[b.r] = a.leads[states.index(came)]

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        first = begins.get(int(rows["_range"].iloc[0]), start)
        told = []
        for _, part in rows.groupby("machine", sort=False):
            told += walk(steps, start if told else first, part["trigger"].tolist())
        rows[["before", "after", "legal"]] = pd.DataFrame(told, columns=["before", "after", "legal"])
        return rows.drop(columns=["_at", "_range"])

    schema = T.StructType([*once.schema.fields, *T._parse_datatype_string(_STEP).fields])
    return cut.groupBy("_range").applyInPandas(finish, schema)


def settled(walked: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """(machine, state, ended, checkpoint, moves, refused) of each machine of :func:`run`: its
    state after all events, and the last state that is no end and that it left, to retry from."""
    order = F.struct("ts", "event_id")
    left = F.when(F.col("legal") & ~F.col("before").isin(*ends), order)
    return walked.groupBy("machine").agg(
        F.max_by("after", order).alias("state"), F.max_by("before", left).alias("checkpoint"), F.count_if("legal").alias("moves"), F.count_if(~F.col("legal")).alias("refused")
    ).withColumn("ended", F.col("state").isin(*ends))


def trigger_of(kinds: Column, names: tuple[str, ...]) -> Column:
    """The name at a place, counted from 0 and around."""
    return F.get(F.array(*map(F.lit, names)), F.pmod(kinds, F.lit(len(names))).cast("int"))
