"""Stateful streams whose state ends: per-host rate limits and job states with timers.

Needs the RocksDB state store (``STORE``), which Spark brings along.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.transitions import LEGAL, STATES, moves

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


class HostLimit(StatefulProcessor):
    """Accepts a host's event if more than ``seconds`` have passed since the last accepted one.

    The time of that one is the host's state. A timer drops it when the watermark says that no later event
    could be turned away by it.
    """

    def __init__(self, key: str, time: str, seconds: float):
        self.key, self.time, self.wait = key, time, round(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows)).sort_values(self.time, kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        known, ok = last, []
        for t in _micros(all_rows[self.time]).tolist():
            free = last is None or t - last > self.wait
            last = t if free else last
            ok.append(free)
        if last != known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer((last + self.wait) // 1000 + 1)
        yield pd.DataFrame({self.key: all_rows[self.key], self.time: all_rows[self.time], "accepted": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, key: str, time: str, seconds: float, late: str = "0 seconds") -> DataFrame:
    """The rule of ``jobs.rate_limited`` over a stream: (key, time, accepted). State ends when the watermark has passed it."""
    kinds = dict(events.dtypes)
    marked = events.select(key, time).withWatermark(time, late).groupBy(key)
    return marked.transformWithStateInPandas(HostLimit(key, time, seconds), f"{key} {kinds[key]}, {time} {kinds[time]}, accepted boolean", "Append", "EventTime")


class JobState(StatefulProcessor):
    """The fold of ``transitions`` over a stream; a job that has ended (complete or error) is forgotten after ``seconds``."""

    def __init__(self, key: str, time: str, tie: str, legal: Mapping[str, Sequence[str]], seconds: float):
        self.key, self.time, self.tie, self.table, self.legal, self.wait = key, time, tie, moves(legal), dict(legal), round(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows)).sort_values([self.time, self.tie])
        now, before, ok, after = (self.state.get()[0] if self.state.exists() else 0), [], [], []
        for e in all_rows["event"]:
            before.append(STATES[now])
            ok.append(e in self.legal and STATES[now] in self.legal[e])
            now = self.table[e][now] if e in self.table else now
            after.append(STATES[now])
        self.state.update((now,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if STATES[now] in ("complete", "error"):
            self.handle.registerTimer(int(_micros(all_rows[self.time]).max()) // 1000 + self.wait)
        yield all_rows.assign(before=before, accepted=ok, after=after)[[self.key, self.tie, "before", "accepted", "after"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def transitions_stream(log: DataFrame, key: str, time: str, tie: str, seconds: float = 7 * 86400, legal: Mapping[str, Sequence[str]] = LEGAL, late: str = "0 seconds") -> DataFrame:
    """(key, tie, before, accepted, after) of each event (column ``event``) of a stream.

    A job whose state has been dropped begins anew, so ``seconds`` is how long an ended one may be taken up again.
    """
    kinds = dict(log.dtypes)
    schema = f"{key} {kinds[key]}, {tie} {kinds[tie]}, before string, accepted boolean, after string"
    marked = log.select(key, time, tie, "event").withWatermark(time, late).groupBy(key)
    return marked.transformWithStateInPandas(JobState(key, time, tie, legal, seconds), schema, "Append", "EventTime")
