"""Runs told from an append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds without activity after which a run of a status is stale.
STALE_SECONDS = {"queued": 180, "stopping": 30, "running": 900}


def latest_state(events: DataFrame) -> DataFrame:
    """One row a run: its last event by (ts, event_id), first and last time, number of events."""
    return events.groupBy("run_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.min("ts").alias("started_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))


def stale(states: DataFrame, now: Column, limits: dict[str, int] = STALE_SECONDS) -> DataFrame:
    """Runs (run_id, status, last_ts) with no activity for longer than their status allows."""
    limit = None
    for status, seconds in limits.items():
        limit = F.when(F.col("status") == status, seconds) if limit is None else limit.when(F.col("status") == status, seconds)
    return states.where(F.unix_timestamp(now) - F.unix_timestamp("last_ts") > limit)


#: Statuses of runs that aren't over.
ACTIVE = ("queued", "running", "stopping")


def active(runs: DataFrame, org: Column | None = None, statuses: tuple[str, ...] = ACTIVE) -> DataFrame:
    """Runs (run_id, org_id, status) of one of the statuses, of one organisation if given. Both conditions reach the scan."""
    rows = runs.where(F.col("status").isin(*statuses))
    return rows if org is None else rows.where(F.col("org_id") == org)


def abandoned(runs: DataFrame, events: DataFrame, now: Column, limits: dict[str, int] = STALE_SECONDS) -> DataFrame:
    """run_id, status, activity: active runs in which nothing happened for as long as their status allows, or longer.

    Activity is the latest of started_at, created_at and the time of the last event by event_id, the later of equals (not the latest time); a run
    without any of them is left alone, as is one of no known status. Expects runs (run_id, status, started_at, created_at)
    and events (run_id, event_id, created_at). One event a run is left before the join; a run with very many events is
    combined before the shuffle."""
    last = events.where("run_id is not null").groupBy("run_id").agg(F.max_by("created_at", F.struct("event_id", "created_at")).alias("event_at"))
    rows = active(runs, statuses=tuple(limits)).select("run_id", "status", "started_at", "created_at").join(last, "run_id", "left")
    rows = rows.select("run_id", "status", F.greatest("started_at", "created_at", "event_at").alias("activity"))
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("status"))
    return rows.where(F.unix_micros(now) - F.unix_micros("activity") >= limit.cast("long") * 1_000_000)


def visible_events(events: DataFrame, runs: DataFrame, profiles: DataFrame, reader: Column) -> DataFrame:
    """The events of runs of the reader's organisations, each once; all columns of ``events``.

    The reader's organisations filter the runs, and those the events, by semi joins: a profile that occurs twice repeats
    nothing. Null organisations and run ids match nothing."""
    orgs = profiles.where(F.col("profile_id") == reader).select("org_id")
    return events.join(runs.join(orgs, "org_id", "left_semi").select("run_id"), "run_id", "left_semi").select(*events.columns)


def visible_counts(events: DataFrame, runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """profile_id, n_runs, n_events: what each profile may see. Events are counted by run, then by organisation, before any
    profile is joined, so the work is no product of events and profiles."""
    by_run = events.where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("n"))
    by_org = runs.where("org_id is not null").select("org_id", "run_id").join(by_run, "run_id", "left").groupBy("org_id").agg(F.count("*").alias("n_runs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_events"))
    seen = profiles.select("profile_id", "org_id").distinct().join(by_org, "org_id", "left")
    return seen.groupBy("profile_id").agg(F.coalesce(F.sum("n_runs"), F.lit(0)).alias("n_runs"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"))
