"""The publication loop against a plain loop over all candidates."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import publication as B

PLAN = (("a", 3, 2), ("b", 2, 0), ("c", 4, 1))
FIELDS = "run_id long, category string, breaking boolean, candidate_id long, score int, source string, story_key string, outcome string, _rank_note string"


def plain(rows, plan, most):
    out = {}
    cap = max(most, sum(t for _, t, _ in plan))
    for run in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == run and r[1] in {c for c, _, _ in plan}]
        active, published, keys, tried = len({r[1] for r in mine}), 0, set(), []
        for category, total, breaking in plan:
            left = cap - published
            total = left if active == 1 else min(total, left)
            breaking = min(breaking, total)
            order = lambda b: sorted((r for r in mine if r[1] == category and bool(r[2]) == b), key=lambda r: (-r[4], r[3]))  # noqa: E731, B023
            hot, calm, bad, n, nb = order(True), order(False), {}, 0, 0
            while n < total and (hot or calm):
                as_breaking = nb < breaking
                pool = (hot or calm) if as_breaking else (calm or hot)
                as_breaking = as_breaking or pool is hot
                k = min(range(len(pool)), key=lambda k: (bad.get(pool[k][5].strip().lower() if pool[k][5] else "", 0), k))
                r = pool.pop(k)
                result = "duplicate_story" if r[6] and r[6] in keys else r[7]
                tried.append((category, r[3], len(tried) + 1, as_breaking, result))
                if result == "published":
                    n, nb, published = n + 1, nb + as_breaking, published + 1
                    keys.add(r[6])
                elif result in B.PENALISED and r[5]:
                    source = r[5].strip().lower()
                    bad[source] = bad.get(source, 0) + 1
        if tried:
            out[run] = tried
    return out


def held(spark, rows, most=0, first=32):
    table = spark.createDataFrame([(*r, "own") for r in rows], FIELDS).repartition(4)
    got = {}
    for r in B.publish(table, [F.desc("score")], PLAN, most, first=first).orderBy("run_id", "turn").collect():
        got.setdefault(r.run_id, []).append((r.category, r.candidate_id, r.turn, r.as_breaking, r.result))
    assert got == plain(rows, PLAN, most)
    return got


def random_rows(seed, n, runs, outcomes):
    rng = random.Random(seed)
    return [(rng.randrange(runs), rng.choice("aaabcd"), rng.choice((True, False, None)), k, rng.randrange(9), rng.choice(("BBC", "bbc ", "TOI", "NDTV", None)), rng.choice(("k1", "k2", "", None, f"k{k}", f"k{k}")), rng.choice(outcomes)) for k in range(n)]


@pytest.mark.parametrize("first", [1, 32])
def test_the_plain_loop_whatever_is_ranked_first(spark, first):
    some = held(spark, random_rows(first, 400, 6, ("published", "image_missing", "workflow_failed", "too_old", "published")), first=first)
    assert {t[4] for tried in some.values() for t in tried} >= {"published", "image_missing", "duplicate_story"}


def test_nearly_all_fail(spark):
    held(spark, random_rows(3, 150, 2, ("image_missing", "workflow_failed", "image_missing", "published")), first=2)
    held(spark, random_rows(4, 60, 2, ("image_missing",)), most=20, first=4)


def test_limits():
    assert B.targets(5, 3, 1, 23) == (23, 3)
    assert B.targets(5, 3, 4, 2) == (2, 2)


def test_alone_in_its_run_takes_what_is_left_and_odd_rows(spark):
    rows = [(1, "a", False, k, k, "s", f"k{k}", "published") for k in range(30)] + [(None, "a", True, 90, 1, "s", "k", "published"), (2, None, True, 91, 1, "s", "k", "published")]
    got = held(spark, rows, most=12, first=3)
    assert len(got[1]) == 12 and 2 not in got


def test_no_candidates(spark):
    assert held(spark, []) == {}
