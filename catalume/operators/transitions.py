"""The states of jobs, from a log of events: which events are legal, and what state each leaves.

An event is accepted if it is legal in the state that the accepted ones before it have left; otherwise the state
stays. Each event is a map from state to state, and maps can be composed in any grouping, so a log is folded by
groups of ``FAN`` neighbouring events, then groups of groups, until every job is one; the states before each group
are then handed down again. No task holds more than ``FAN`` maps of a job at once, however long its log is, and
the number of levels grows with the logarithm. A restart wipes a job's steps: of these only those after the last
accepted start stay.

Edge cases: an unknown or null event is never accepted; events of one time are taken by the tie column; a null job
is one job; an empty log gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: The states of a job; and for each event the states in which it is legal. A step leaves the state.
STATES = ("none", "pending", "queued", "processing", "complete", "error")
LEGAL = {
    "pending": ("none",),
    "queued": ("none", "pending", "complete", "error"),
    "processing": ("pending", "queued", "processing"),
    "complete": ("processing",),
    "error": ("processing",),
    "step": ("processing",),
}
FAN_BITS = 8


def moves(legal: Mapping[str, Sequence[str]] = LEGAL) -> dict[str, list[int]]:
    """For each event the state that it leaves, by the state before, as numbers."""
    after = lambda event, s: STATES.index(event) if event in STATES else s
    return {event: [after(event, i) if s in states else i for i, s in enumerate(STATES)] for event, states in legal.items()}


def _map_of(event: Column, legal: Mapping[str, Sequence[str]]) -> Column:
    same = F.array(*[F.lit(i) for i in range(len(STATES))])
    out = F.when(F.lit(False), same)
    for name, to in moves(legal).items():
        out = out.when(event == name, F.array(*[F.lit(i) for i in to]))
    return out.otherwise(same)


def transitions(log: DataFrame, key: str, time: str, tie: str, event: str = "event", legal: Mapping[str, Sequence[str]] = LEGAL) -> DataFrame:
    """``log`` with ``at`` (its order, jobs one after another), ``before``, ``accepted`` and ``after``."""
    order = [key, time, tie]
    rows = log.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialise(rows, "log")  # numbered once
    level = rows.select(F.col(key).alias("job"), F.col("at").alias("id"), _map_of(F.col(event), legal).alias("m"))
    parts, jobs = [], rows.select(key).distinct().count()
    while True:
        both = F.array_sort(F.collect_list(F.struct("id", "m"))).alias("parts")  # FAN at most
        up = materialise(level.groupBy("job", F.shiftright("id", FAN_BITS).alias("id")).agg(both), "parts")
        parts.append(up)
        if up.count() <= jobs:
            break
        composed = F.aggregate("parts", F.array(*[F.lit(i) for i in range(len(STATES))]), lambda m, p: F.transform(m, lambda s: F.get(p["m"], s)))
        level = up.select("job", "id", composed.alias("m"))
    states = parts[-1].select("job", "id", F.lit(0).alias("state"))
    for up in reversed(parts):
        begin = F.struct(F.col("state").alias("s"), F.array().cast("array<int>").alias("out"))
        scan = F.aggregate("parts", begin, lambda acc, p: F.struct(F.get(p["m"], acc["s"]).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")), lambda acc: acc["out"])
        other = states.withColumnsRenamed({"job": "__job", "id": "__id"})
        held = up.join(other, F.col("job").eqNullSafe(F.col("__job")) & (F.col("id") == F.col("__id")))
        states = held.select("job", F.explode(F.arrays_zip(F.transform("parts", lambda p: p["id"]).alias("id"), scan.alias("state"))).alias("c")).select("job", "c.id", "c.state")
    named = F.array(*[F.lit(s) for s in STATES])
    told = rows.join(states.select(F.col("id").alias("at"), F.get(named, F.col("state")).alias("before")), "at")
    allowed = F.lit(False)
    for name, legal_in in legal.items():
        allowed = allowed | ((F.col(event) == name) & F.col("before").isin(*legal_in))
    told = told.withColumn("accepted", F.coalesce(allowed, F.lit(False)))
    moved = F.col("accepted") & F.col(event).isin(*[e for e in legal if e in STATES])
    return told.withColumn("after", F.when(moved, F.col(event)).otherwise(F.col("before"))).select(*log.columns, "at", "before", "accepted", "after")


def steps_kept(told: DataFrame, key: str, event: str = "event", start: str = "processing", step: str = "step") -> DataFrame:
    """The accepted steps after each job's last accepted start."""
    last = told.where(F.col("accepted") & (F.col(event) == start)).groupBy(F.col(key).alias("__key")).agg(F.max("at").alias("__from"))
    steps = told.where(F.col("accepted") & (F.col(event) == step))
    return steps.join(last, F.col(key).eqNullSafe(F.col("__key"))).where(F.col("at") > F.col("__from")).drop("__key", "__from")


def current(told: DataFrame, key: str) -> DataFrame:
    """(key, status, illegal): each job's state after its log, and how many of its events were turned away."""
    return told.groupBy(key).agg(F.max_by("after", "at").alias("status"), F.count_if(~F.col("accepted")).alias("illegal"))
