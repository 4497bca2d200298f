"""Stateful streams whose state ends by event-time timers: sustained alerts and status progress with a timeout.

Both run on `transformWithStateInPandas`, so the session needs the RocksDB state store (`with_state_store`). State is a
few values for each key and goes when a timer says that nothing can follow; rows later than the watermark are dropped
by Spark before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import PROGRESS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


class SustainedAlert(StatefulProcessor):
    """One run of firing evaluations for each key: first and last time in seconds, how many, whether it was reported."""

    def __init__(self, key: str, at_least: int, step: int, wait: int):
        self.key, self.at_least, self.step, self.wait = key, at_least, step, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first long, last long, n long, told boolean")

    def rows(self, key: tuple, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            kind, first, last, n = zip(*found, strict=True)
            yield pd.DataFrame({self.key: [key[0]] * len(found), "kind": kind, "start": pd.to_datetime(first, unit="s"), "end": pd.to_datetime(last, unit="s"), "n": n})

    def forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = []
        first, last, n, told = self.run.get() if self.run.exists() else (0, 0, 0, False)
        for at, firing in sorted((int(t), bool(f)) for d in rows for t, f in zip(d["at"], d["firing"], strict=True)):
            if n and (not firing or at != last + self.step):
                if n >= self.at_least:
                    found.append(("resolved", first, last, n))
                n, told = 0, False
            if firing:
                first, last, n = (at if not n else first), at, n + 1
                if n >= self.at_least and not told:
                    found.append(("firing", first, last, n))
                    told = True
        self.forget_timers()
        if n:
            self.run.update((first, last, n, told))
            # The evaluation that would carry on has come in by then, if there is one.
            self.handle.registerTimer((last + self.step + self.wait) * 1000)
        else:
            self.run.clear()
        yield from self.rows(key, found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            first, last, n, _ = self.run.get()
            self.run.clear()
            yield from self.rows(key, [("resolved", first, last, n)] if n >= self.at_least else [])

    def close(self) -> None:
        pass


def sustained_alerts(evaluations: DataFrame, firing: Column, at_least: int, step_seconds: int, width_seconds: int, key: str = "alert", start: str = "start") -> DataFrame:
    """K4, stream: (key, kind, start, end, n) of runs of at_least firing evaluations, one step apart.

    evaluations (key, start, ...) is a stream with a watermark, such as a windowed aggregate of windows that are
    width_seconds wide. "firing" is told when a run is long enough, "resolved" when it is over: at an evaluation that
    does not fire, or when the watermark has passed the time at which the next one would have come. Only the run that is
    open is kept; an evaluation without rows ends a run as one that does not fire.
    """
    at = F.unix_timestamp(F.col(start).cast("timestamp"))
    d = evaluations.select(key, start, at.alias("at"), F.coalesce(firing, F.lit(False)).alias("firing"))
    kind = evaluations.schema[key].dataType.simpleString()
    return d.groupBy(key).transformWithStateInPandas(SustainedAlert(key, at_least, step_seconds, width_seconds), f"{key} {kind}, kind string, start timestamp, end timestamp, n long", "Append", "EventTime")


class Progress(StatefulProcessor):
    """The last status of each key, with a timer that tells when nothing has come for too long."""

    def __init__(self, key: str, timeout: int, percent: dict[str, int]):
        self.key, self.timeout, self.percent = key, timeout, percent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, id string, status string")

    def row(self, key: tuple, status: str, timed_out: bool, us: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "status": [status], "percent": [self.percent.get(status, 0)], "timed_out": [timed_out], "at": [pd.Timestamp(us, unit="us")]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        new = max(((int(u), str(i), s) for d in rows for u, i, s in zip(d["us"], d["id"], d["status"], strict=True)), key=lambda x: (x[0], len(x[1]), x[1]), default=None)
        if new is None or (known and (known[0], len(known[1]), known[1]) >= (new[0], len(new[1]), new[1])):
            return
        self.last.update(new)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(new[0] // 1000 + self.timeout * 1000 + 1)  # for a terminal status, when it is forgotten
        yield self.row(key, new[2], False, new[0])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            us, _, status = self.last.get()
            self.last.clear()  # rows as old as the one forgotten are late by now
            if status not in ("completed", "failed"):
                yield self.row(key, status, True, us)

    def close(self) -> None:
        pass


def status_progress(events: DataFrame, key: str, timeout_seconds: int = 300, wait: str = "1 minute", ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """K9, stream: (key, status, percent, timed_out, at) whenever a key's status moves on, and once when it has been silent for too long.

    A status that is older than the last one changes nothing. Silence is told by a timer, without a new row of that key:
    as soon as the watermark, the latest time seen less wait, is timeout_seconds past the last status. State is freed then,
    for completed and failed keys as well.
    """
    d = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, wait)
    d = d.select(key, ts, F.unix_micros(ts).alias("us"), F.col(id_).cast("string").alias("id"), "status")
    kind = events.schema[key].dataType.simpleString()
    return d.groupBy(key).transformWithStateInPandas(Progress(key, timeout_seconds, PROGRESS), f"{key} {kind}, status string, percent int, timed_out boolean, at timestamp", "Append", "EventTime")
