"""Streams with state a key and timers on event time: the run machine, and stories that are published once a span.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). State is small and goes by timer, so
it is bounded by what is alive, not by what was ever seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.run_machine import FINAL, after
from ..operators.runs import STALE_SECONDS


class RunMachine(StatefulProcessor):
    """A row (run_id, status, ended_us, stale, last_us) whenever a run's status changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "status string, last_us bigint")

    def _row(self, key, status, ended, stale, last) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "status": [status], "ended_us": pd.array([ended], "Int64"), "stale": [stale], "last_us": [last]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last = self.state.get() if self.state.exists() else ("none", None)
        events = pd.concat(rows).sort_values(["us", "event_id"])
        for us, action in zip(events["us"].tolist(), events["action"].tolist(), strict=True):
            if last is not None and status in STALE_SECONDS and us - last >= STALE_SECONDS[status] * 1_000_000:
                ended = last + STALE_SECONDS[status] * 1_000_000
                status = "cancelled"
                yield self._row(key, status, ended, True, last)
            new, last = after(status, action), max(us, last or us)
            if new != status:
                status = new
                yield self._row(key, status, us if status in FINAL else None, False, last)
        self.state.update((status, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status in STALE_SECONDS:
            self.handle.registerTimer((last + STALE_SECONDS[status] * 1_000_000) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last = self.state.get()
        if status in STALE_SECONDS:
            self.state.update(("cancelled", last))
            yield self._row(key, "cancelled", last + STALE_SECONDS[status] * 1_000_000, True, last)

    def close(self) -> None:
        pass


def run_statuses(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Status changes of runs from a stream of (run_id, ts, event_id, action); agrees with ``run_machine.histories`` when
    events arrive in order. ``late`` is how long the stream waits before silence counts."""
    keyed = events.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late).groupBy("run_id")
    kind = dict(events.dtypes)["run_id"]
    return keyed.transformWithStateInPandas(RunMachine(), f"run_id {kind}, status string, ended_us bigint, stale boolean, last_us bigint", "Update", "EventTime")


class PublishedOnce(StatefulProcessor):
    """Verdicts on stories: published, duplicate of one published within the span, or rejected."""

    def __init__(self, hours: int):
        self.span_us = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.published = handle.getValueState("published", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.published.get()[0] if self.published.exists() else None
        out = []
        for us, item, fit in pd.concat(rows).sort_values(["us", "item_id"])[["us", "item_id", "fit"]].itertuples(index=False):
            if last is not None and abs(us - last) < self.span_us:
                verdict = "duplicate"
            elif pd.isna(fit) or not fit:
                verdict = "rejected"
            else:
                verdict, last = "published", us if last is None else max(us, last)
            out.append((key[0], item, verdict))
        if last is not None:
            self.published.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.span_us) // 1000)
        yield pd.DataFrame(out, columns=["story_key", "item_id", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.published.clear()
        return iter(())

    def close(self) -> None:
        pass


def published_once(stories: DataFrame, hours: int = 48, late: str = "1 hour") -> DataFrame:
    """story_key, item_id, verdict from a stream of (story_key, item_id, ts, fit).

    Only what was published counts: a row that isn't ``fit`` blocks nothing. A late row is a duplicate if its story was
    published less than the span after it. A story's state goes when the span has passed."""
    keyed = stories.where("story_key IS NOT NULL AND ts IS NOT NULL").withColumn("us", F.unix_micros("ts")).withWatermark("ts", late).groupBy("story_key")
    return keyed.transformWithStateInPandas(PublishedOnce(hours), f"story_key string, item_id {dict(stories.dtypes)['item_id']}, verdict string", "Append", "EventTime")
