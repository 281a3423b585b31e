"""Sections of listing pages; abandoned runs; who may see which events."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from textloom.operators import links as H
from textloom.operators import runs as R

T0 = datetime(2024, 1, 1)


def found(spark, name, section, html):
    return spark.createDataFrame([(html,)], "h string").select(H.article_links(F.col("h"), H.of_section(name, section)).alias("l")).first().l


def test_sections(spark):
    toi = '<a href="/sports/a/articleshow/1.cms"><a href="/india/b/articleshow/2.cms"><a href="https://timesofindia.indiatimes.com/world/c/articleshow/3.cms">'
    at = "https://timesofindia.indiatimes.com"
    assert found(spark, "toi", "/sports/cricket", toi) == [f"{at}/sports/a/articleshow/1.cms", f"{at}/world/c/articleshow/3.cms"]
    assert found(spark, "toi", "", toi) == [f"{at}/india/b/articleshow/2.cms", f"{at}/world/c/articleshow/3.cms"]
    reuters = '<a href="/item-ABCDEF1/"><a href="/business/x-ABCDEF2/"><a href="/world/x/y/z-1"><a href="/item-ABCDEF3">'
    at = "https://www.reuters.com"
    assert found(spark, "reuters", "business", reuters) == [f"{at}/business/x-ABCDEF2/"]
    assert found(spark, "reuters", "", reuters) == [f"{at}/business/x-ABCDEF2/", f"{at}/world/x/y/z-1", f"{at}/item-ABCDEF3"]
    guardian = "".join(f'<a href="/{s}/2024/jan/{d}/x">' for s, d in (("sport", 1), ("sport", 2), ("sport", 3), ("world", 9), ("sport", 4), ("sport", 5), ("sport", 6)))
    assert len(found(spark, "guardian", "sport", guardian)) == 6 and len(found(spark, "guardian", "world", guardian)) == 7 and found(spark, "guardian", "", guardian)[0].endswith("/world/2024/jan/9/x")
    assert found(spark, "guardian", "", None) == [] and H.of_section("bbc", "x") == H.RULES["bbc"]


def test_abandoned(spark):
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    rows = [(1, "queued", None, 0), (2, "queued", None, 1), (3, "running", 50, 0), (4, "stopping", None, 0), (5, "completed", None, 0), (6, "running", None, None), (7, "running", None, 0), (8, None, None, 0), (None, "queued", None, 0)]
    runs = spark.createDataFrame([(r, s, at(a), at(c)) for r, s, a, c in rows], "run_id long, status string, started_at timestamp, created_at timestamp")
    # the last event of run 4 by its number is an early one; run 7's is fresh
    events = spark.createDataFrame([(4, 1, at(170)), (4, 2, at(20)), (7, 3, at(170)), (None, 9, at(179))], "run_id long, event_id long, created_at timestamp")
    got = R.abandoned(runs, events, F.lit(at(180)), {"queued": 180, "stopping": 30, "running": 100}).collect()
    assert {(r.run_id, r.activity) for r in got} == {(1, at(0)), (3, at(50)), (4, at(20)), (None, at(0))}
    assert R.abandoned(runs, events.limit(0), F.lit(at(0))).count() == 0


def test_visible(spark):
    runs = spark.createDataFrame([(1, 10, "running"), (2, 10, "completed"), (3, 20, "queued"), (4, None, "queued")], "run_id long, org_id int, status string")
    events = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (None, 6)], "run_id long, event_id long")
    profiles = spark.createDataFrame([(7, 10), (7, 10), (7, 20), (8, 20), (9, None), (6, 30)], "profile_id long, org_id int")
    see = lambda who: sorted(r.event_id for r in R.visible_events(events, runs, profiles, F.lit(who)).collect())
    assert (see(7), see(8), see(9), see(6)) == ([1, 2, 3, 4], [4], [], [])
    got = {r.profile_id: (r.n_runs, r.n_events) for r in R.visible_counts(events, runs, profiles).collect()}
    assert got == {7: (3, 4), 8: (1, 1), 9: (0, 0), 6: (0, 0)}
    assert sorted(r.run_id for r in R.active(runs).collect()) == [1, 3, 4] and [r.run_id for r in R.active(runs, F.lit(20)).collect()] == [3]
