"""Histories and loose JSON."""

import json
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from textloom.sources import histories as H
from textloom.sources import loose_json as J

DAY = datetime(2024, 1, 1)
RUNS = "run_id string, status string, worker string"
PUBLISHED = "url string, title string, story_key string, image_url string, published_at timestamp"


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def published(spark, *rows):
    return H.published_rows(spark.createDataFrame([(*r, DAY + timedelta(hours=k), "own") for k, r in enumerate(rows)], PUBLISHED + ", note string"))


def test_upsert_cuts_keeps_the_last_and_takes_a_batch_once(spark, tmp_path):
    history = H.History(spark, str(tmp_path / "h"), PUBLISHED, "url")
    assert history.read().collect() == []
    batch = published(spark, ("HTTPS://A.org/x/?q", " t" * 400, "k" * 70, "i" * 1100), ("https://a.org/x", "later", None, ""), (None, "no url", "", ""), ("https://b.org/", "b", "k", None))
    order = [F.col("published_at")]
    assert history.upsert(batch, order, "w", 0) and not history.upsert(batch, order, "w", 0)
    assert as_rows(history.read()) == [("https://a.org/x", "later", "", "", DAY + timedelta(hours=1)), ("https://b.org/", "b", "k", "", DAY + timedelta(hours=3))]
    assert history.upsert(published(spark, ("https://b.org", "t" * 600, "s" * 70, "i" * 1100)), order, "w", 1)
    got = {r.url: r for r in history.read().collect()}
    assert [len(got["https://b.org/"][n]) for n in ("title", "story_key", "image_url")] == [512, 64, 1024] and len(got) == 2
    assert history.upsert(batch, order, "other", 0)
    for k in range(4):
        history.upsert(batch, order, "w", 2 + k)
    assert len([p for p in (tmp_path / "h").iterdir() if p.name.startswith("data-")]) <= 3


def test_the_second_of_two_writers_starts_again(spark, tmp_path):
    history, other = (H.History(spark, str(tmp_path / "h"), RUNS, "run_id") for _ in range(2))
    row = lambda *r: spark.createDataFrame([r], RUNS)
    history.upsert(row("a", "queued", None), [F.col("status")])
    real, tries = history._create, []

    def slow(path, text):
        if not tries:
            tries.append(path)
            other.upsert(row("b", "queued", None), [F.col("status")])  # comes in between
        return real(path, text)

    history._create = slow
    history.upsert(row("c", "queued", None), [F.col("status")])
    assert [r[0] for r in as_rows(history.read())] == ["a", "b", "c"]


def test_one_of_two_claimants_wins(spark, tmp_path):
    history = H.History(spark, str(tmp_path / "h"), RUNS, "run_id")
    history.upsert(spark.createDataFrame([("a", "queued", "-"), ("b", "running", "old"), ("c", "queued", "-")], RUNS), [F.col("status")])
    claims = spark.createDataFrame([("a", "w2", 2), ("a", "w1", 1), ("b", "w1", 1), ("d", "w1", 1)], "run_id string, worker string, at int")
    claim = lambda: as_rows(history.claim(claims, "status", "queued", "running", "worker", [F.col("at"), F.col("worker")]))
    assert claim() == [("a", "w1", 1)] and claim() == []
    assert {r.run_id: r.status for r in history.read().collect()} == {"a": "running", "b": "running", "c": "queued"}


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    schema = "url string, status string, ts timestamp"
    for k in range(3):
        spark.createDataFrame([("https://a.org/1", f"s{k}", DAY + timedelta(hours=k)), (f"https://a.org/{k}x", "failed", DAY)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    history = H.History(spark, str(tmp_path / "h"), schema, "url")
    sink, seen = history.sink([F.col("ts")], "stream"), []

    def twice(rows, batch):
        seen.append(batch)
        sink(rows, batch)
        sink(rows, batch)

    run = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert run.awaitTermination(120) and not run.exception() and len(seen) == 3 and len(history._commits()) == 3
    assert {r.url: r.status for r in history.read().collect()}["https://a.org/1"] == "s2"


def plain_object(raw):
    text = (raw or "").strip()
    if text.startswith("```"):
        text = text.strip("`").replace("json", "", 1).strip()
    for part in (text, (re.findall(r"(?s)\{.*\}", text) or [None])[0]):
        try:
            json.loads(part)
            return part
        except Exception:  # noqa: BLE001
            pass


def test_objects_in_fences_and_prose(spark):
    values = ['{"a": 1}', '```json\n{"a": 1}\n```', '```\n{"a": 1}```', 'Sure: {"a": 1} is it', '{"a": 1', "no", "", None, '{"a": "x"} {"b": 2}', '``` json {"a": {"b": [1, 2]}} ```', "[1]", '{"a": null}']
    table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    rows = table.select("k", J.found_object(F.col("v")).alias("o"), J.typed(F.col("v"), "a int")["a"].alias("a")).orderBy("k").collect()
    assert [r.o for r in rows] == [plain_object(v) for v in values]
    assert [r.a for r in rows][:5] == [1, 1, 1, 1, None]


def test_bad_lines_stay_apart(spark, tmp_path):
    lines = ['{"t": " a  b ", "n": 1}', "", '{"t": ""}', "broken {", '{"n": 3}', "﻿" + '{"t": "bom"}', "[1]", '{"t": "x", "more": 1}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    good, bad = J.read_lines(spark, str(tmp_path / "x.jsonl"), "t string, n int", ("t",))
    assert as_rows(good.fillna(0)) == [("a b", 1), ("x", 0)]
    assert sorted(r.reason for r in bad.collect()) == ["incomplete", "incomplete", "not_json", "not_json", "not_json"]


def test_passing_results_go(spark):
    import os

    from textloom.sources.stored import Scope, passing, shared_root

    there = lambda: {f for f in os.listdir(shared_root(spark).removeprefix("file:")) if f.startswith("kept-")}
    before = there()
    with passing(spark):
        with Scope(spark) as scope:
            inner = scope.result(spark.range(3).toDF("n"), "kept")
        assert inner.count() == 3 and len(there() - before) == 1
    assert there() == before
    with Scope(spark) as scope:
        assert scope.result(spark.range(3).toDF("n"), "kept").count() == 3
    assert len(there() - before) == 1
