"""The run machine, in pieces and as a stream, and stories published once, against plain folds."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from textloom.operators import run_machine as M
from textloom.operators.runs import STALE_SECONDS
from textloom.streaming import keyed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FIELDS = "run_id string, ts timestamp, event_id long, action string"


def plain(events, now):
    """events: (run_id, datetime, event_id, action)."""
    out = {}
    for run in {e[0] for e in events}:
        status, last, ended, stale = "none", None, None, False
        for _, ts, _, action in [*sorted((e for e in events if e[0] == run), key=lambda e: e[1:3]), (run, now, None, None)]:
            if last and status in STALE_SECONDS and ts - last >= timedelta(seconds=STALE_SECONDS[status]):
                ended, stale, status = last + timedelta(seconds=STALE_SECONDS[status]), True, "cancelled"
            if action is None and ts == now:
                break
            new = M.MOVES.get(action, {}).get(status, status)
            ended = ts if new in M.FINAL and status not in M.FINAL else ended
            status, last = new, ts
        out[run] = (status, ended, stale)
    return out


def random_events(seed, runs=150, each=14):
    rng = random.Random(seed)
    out = [(run, START + timedelta(seconds=k), k, action) for run in ("fails", "stops", "again") for k, action in enumerate(
        {"fails": ("queue", "claim", "fail", "finish"), "stops": ("queue", "claim", "stop", "finish"), "again": ("queue", "claim", "requeue", "claim", "finish")}[run])]
    for r in range(runs):
        at = START + timedelta(seconds=rng.randrange(4000))
        for _ in range(rng.randrange(1, each)):
            at += timedelta(seconds=rng.choice((0, 1, 1, 5, 9, 20, 29, 30, 31, 179, 180, 181, 600, 899, 900, 901)))
            out.append((f"r{r}", at, len(out) + 50, rng.choice([*M.MOVES, None, "other"]) if rng.random() < 0.6 else ("queue", "claim", "step", "finish", "fail")[min(4, rng.randrange(6))]))
    return out


@pytest.mark.parametrize("piece", [1, 60, 3600, 10**7])
def test_pieces_of_any_length_give_the_plain_fold(spark, piece):
    events, now = random_events(piece), START + timedelta(hours=3)
    table = spark.createDataFrame(events, FIELDS).repartition(5)
    got = {r.run_id: (r.status, r.ended_ts and r.ended_ts.replace(tzinfo=timezone.utc), r.stale) for r in M.histories(table, F.lit(now), piece).collect()}
    assert got == plain(events, now)
    assert {s for s, _, _ in got.values()} >= {"cancelled", "succeeded", "failed"}


def test_rows_without_run_or_time_and_no_rows(spark):
    table = spark.createDataFrame([(None, START, 1, "queue"), ("a", None, 2, "queue")], FIELDS)
    assert M.histories(table, F.lit(START)).collect() == [] == M.histories(table.limit(0), F.lit(START)).collect()


@pytest.fixture
def rocks(spark):
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, was)


def streamed(spark, tmp_path, batches, schema, make):
    """The rows that a stream gives over batches that arrive one after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = []
    run = make(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "at")).outputMode("update").trigger(availableNow=True).start()
    assert run.awaitTermination(150) and not run.exception()
    return got


def test_stream_agrees_with_the_fold(spark, rocks, tmp_path):
    events = sorted(random_events(8, 15), key=lambda e: e[1:3])
    end = START + timedelta(days=1)
    batches = [events[: len(events) // 2], events[len(events) // 2 :], [("last", end, 10**6, "other")]]
    got = {}
    for r in streamed(spark, tmp_path, batches, FIELDS, keyed.run_statuses):
        got[r.run_id] = (r.status, START + timedelta(microseconds=r.ended_us - int(START.timestamp()) * 10**6) if r.ended_us is not None else None, r.stale)
    want = {k: v for k, v in plain(events, end).items() if v[0] != "none"}
    assert got == want


def test_only_what_was_published_blocks(spark, rocks, tmp_path):
    hour = lambda h: START + timedelta(hours=h)
    batches = [
        [("a", 1, hour(100), False), ("b", 2, hour(100), True), (None, 3, hour(100), True)],  # rejected; published
        [("a", 4, hour(101), True), ("b", 5, hour(99.5), True), ("b", 6, hour(147), True), ("c", 7, hour(101), None)],  # published; late; within; null
        [("b", 8, hour(148), True), ("a", 9, hour(149), True), ("a", 10, hour(150), True)],  # just expired; expired; within
        [("z", 11, hour(400), False)], [("a", 12, hour(401), True)],
    ]
    got = {r.item_id: r.verdict for r in streamed(spark, tmp_path, batches, "story_key string, item_id long, ts timestamp, fit boolean", keyed.published_once)}
    assert got == {1: "rejected", 2: "published", 4: "published", 5: "duplicate", 6: "duplicate", 7: "rejected", 8: "published", 9: "published", 10: "duplicate", 11: "rejected", 12: "published"}
