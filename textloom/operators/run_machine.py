"""The life of a run told from its events: queued, running, stopping, and how it ended.

An event is a function from states to states. Functions compose, so a run's events are composed in pieces of bounded time
and the pieces after: no task needs all events of a run, however many it has. Silence counts too: a piece knows when it
begins and ends, and a run that was silent longer than its state allows has been cancelled in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import STALE_SECONDS

# States, which of them are final, and what each event makes of each state.
STATES = ("none", "queued", "running", "stopping", "succeeded", "failed", "cancelled")
FINAL = ("succeeded", "failed", "cancelled")
#: Only a queued run can be claimed; a stop that was asked for wins over the outcome; a final state stays.
MOVES = {
    "queue": {"none": "queued"}, "claim": {"queued": "running"}, "step": {}, "stop": {"queued": "stopping", "running": "stopping"},
    "cancel": {"queued": "cancelled", "running": "cancelled", "stopping": "cancelled"}, "requeue": {"running": "queued"},
    "finish": {"running": "succeeded", "stopping": "cancelled"}, "fail": {"running": "failed", "stopping": "cancelled"},
}

_END = "struct<state:int,ended:bigint,stale:boolean>"


def after(state: str, action: str | None) -> str:
    return MOVES.get(action, {}).get(state, state)


def _limits() -> Column:
    """Microseconds of silence that each state allows; null: any."""
    return F.array(*(F.lit(STALE_SECONDS[s] * 1_000_000 if s in STALE_SECONDS else None).cast("bigint") for s in STATES))


def _silent(end: Column, last: Column, until: Column) -> Column:
    """An end state after silence from ``last`` to ``until``."""
    limit = F.get(_limits(), end["state"])
    gone = F.struct(F.lit(STATES.index("cancelled")).alias("state"), (last + limit).alias("ended"), F.lit(True).alias("stale"))
    return F.when(limit.isNotNull() & (until - last >= limit), gone).otherwise(end)


def _composed(pieces: Column) -> Column:
    """One piece (first, last, ends: where each state leads) of an array of pieces in order."""
    def follow(a: Column, b: Column) -> Column:
        def through(end: Column) -> Column:
            quiet = F.transform(F.array(_silent(end, a["last"], b["first"])), lambda q: F.when(q["ended"].isNotNull(), q).otherwise(F.get(b["ends"], q["state"])))
            return F.get(quiet, F.lit(0))

        return F.struct(a["first"].alias("first"), b["last"].alias("last"), F.transform(a["ends"], through).alias("ends"))

    return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.element_at(pieces, 1), follow)


def histories(events: DataFrame, now: Column, piece_seconds: int = 3600) -> DataFrame:
    """run_id, status, ended_ts (null while it lives), stale (ended by silence), last_ts: each run at ``now``.

    events: run_id, ts, event_id, action. Events of a run count in order of (ts, event_id); an unknown or null action is a
    sign of life alone, and so is one that a state doesn't know. Rows without a run or a time don't count."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where("run_id IS NOT NULL AND ts IS NOT NULL").select("run_id", us.alias("at"), "event_id", "action")
    leads = F.when(F.lit(False), F.array(F.lit(0)))
    for action in MOVES:
        leads = leads.when(F.col("action") == action, F.array(*(F.lit(STATES.index(after(s, action))) for s in STATES)))
    leads = leads.otherwise(F.array(*(F.lit(k) for k in range(len(STATES)))))
    first_final = STATES.index(FINAL[0])
    ends = F.transform(leads, lambda to, k: F.struct(to.alias("state"), F.when((to >= first_final) & (k < first_final), F.col("at")).alias("ended"), F.lit(False).alias("stale")).cast(_END))
    rows = rows.select("run_id", "at", "event_id", F.struct(F.col("at").alias("first"), F.col("at").alias("last"), ends.alias("ends")).alias("piece"))
    ordered = lambda *key: F.transform(F.array_sort(F.collect_list(F.struct(*key, "piece")), _by(len(key))), lambda x: x["piece"])
    pieces = rows.groupBy("run_id", F.floor(F.col("at") / (piece_seconds * 1_000_000)).alias("part")).agg(_composed(ordered("at", "event_id")).alias("piece"))
    runs = pieces.groupBy("run_id").agg(_composed(ordered("part")).alias("whole"))
    end = _silent(F.get("whole.ends", F.lit(0)), F.col("whole.last"), F.unix_micros(now))
    names = F.array(*map(F.lit, STATES))
    return runs.select("run_id", end.alias("end"), "whole.last").select(
        "run_id", F.get(names, F.col("end.state")).alias("status"), F.timestamp_micros("end.ended").alias("ended_ts"), F.col("end.stale").alias("stale"), F.timestamp_micros("last").alias("last_ts"))


def _by(n: int):
    """Order of structs by their first ``n`` fields: the last one holds no order."""
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        names = (["at", "event_id"] if n == 2 else ["part"])
        for name in reversed(names):
            out = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(out)
        return out

    return compare
