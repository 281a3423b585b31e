"""Streams: first stories within a time span, and run states from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_in_span(stream: DataFrame, key: str = "story_key", ts: str = "ts", hours: int = 48) -> DataFrame:
    """Each key once while its state is kept: state older than the watermark is dropped, so it stays bounded."""
    return stream.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def event_counts(stream: DataFrame, minutes: int = 60, late_minutes: int = 60) -> DataFrame:
    """Events a type and window."""
    windowed = stream.withWatermark("ts", f"{late_minutes} minutes").groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("start_ts"), "event_type", "n")


def run_states(stream: DataFrame) -> DataFrame:
    """The latest event of each run, for update or complete mode."""
    return stream.groupBy("run_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.count("*").alias("n_events"))
