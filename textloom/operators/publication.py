"""The publication loop: which candidates of a run are tried, in what order, when outcomes feed back.

What happens to a candidate changes what is tried next: a source whose pictures or forms fail moves back, a story that was
published blocks its retellings, and what one category leaves over another may use. That is a fold; it runs once a run, over
the first few ranked candidates of each category alone. A fold that would have needed a later one says so, and its run is
folded again over twice as many; the answer is that of the fold over all."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..sources.stored import Scope

#: Outcomes that count against a source.
PENALISED = ("image_missing", "workflow_failed")
_FIELDS = "category string, candidate_id bigint, turn int, as_breaking boolean, result string, more boolean"


def targets(total: int, breaking: int, active: int, left: int) -> tuple[int, int]:
    """A category's targets: one that is alone takes all that is left, others no more than that."""
    total = left if active == 1 else min(total, left)
    return total, max(0, min(breaking, total))


class Pool:
    """Ranked candidates that come out by (failures of their source, rank)."""

    def __init__(self, rows: list, cut: bool):
        self.queues: dict[str, deque] = defaultdict(deque)
        for k, row in enumerate(rows):
            self.queues[row["source"]].append((k, row))
        self.left, self.cut = len(rows), cut

    def pop(self, failures: dict[str, int]):
        """The next candidate, and whether one beyond the cut might have come before it."""
        source = min((s for s, q in self.queues.items() if q), key=lambda s: (failures[s], self.queues[s][0][0]))
        self.left -= 1
        return self.queues[source].popleft()[1], self.cut and failures[source] > 0


def fold(candidates: dict[str, tuple[Pool, Pool]], plan: Iterable[tuple[str, int, int]], cap: int) -> tuple[list[tuple], bool]:
    """(category, candidate_id, turn, as_breaking, result) of all that were tried, and whether more candidates are needed.

    Breaking candidates come first until the category's breaking target is met; where they run out, normal ones are taken
    as breaking. A candidate whose story was published is passed over; one that fails leaves its place to the next."""
    out, published, keys = [], 0, set()
    for category, total, breaking in plan:
        total, breaking = targets(total, breaking, len(candidates), cap - published)
        if published >= cap or total <= 0:
            break
        if category not in candidates:
            continue
        hot, calm = candidates[category]
        failures: dict[str, int] = defaultdict(int)
        done = done_breaking = 0
        while done < total:
            wants = done_breaking < breaking
            pool = next((p for p in ((hot, calm) if wants else (calm, hot)) if p.left or p.cut), None)
            if pool is None:
                break
            if not pool.left:
                return out, True
            row, unsure = pool.pop(failures)
            if unsure:
                return out, True
            as_breaking = pool is hot or wants
            result = "duplicate_story" if row["story_key"] and row["story_key"] in keys else row["outcome"]
            out.append((category, row["candidate_id"], len(out) + 1, as_breaking, result))
            if result == "published":
                done, published, done_breaking = done + 1, published + 1, done_breaking + as_breaking
                keys.add(row["story_key"])
            elif result in PENALISED and row["source"]:
                failures[row["source"]] += 1
    return out, False


def publish(candidates: DataFrame, order: list[Column], plan: tuple[tuple[str, int, int], ...] = L.PLAN, most: int = 0, run: str = "run_id", first: int = 32) -> DataFrame:
    """``run``, category, candidate_id, turn (from 1), as_breaking, result: every candidate that a run tries.

    candidates: run, category, breaking, candidate_id, source, story_key, outcome (what would come of trying it:
    'published' or why not) and whatever ``order`` ranks by within (run, category, breaking); ties go to the smaller id. A
    run publishes ``most`` at most, or the plan's total if that is more. Null breaking is false, a null source or story key
    is none. Candidates without a run, category or id don't count. Ranks are cut before the shuffle, so a category that
    holds most candidates sends a few from each task."""
    cap = max(most, sum(total for _, total, _ in plan))
    with Scope(candidates.sparkSession) as scope:
        rows = candidates.where(F.col(run).isNotNull() & F.col("candidate_id").isNotNull() & F.col("category").isin(*(c for c, _, _ in plan)))
        sides = Window.partitionBy("_run", "category", "breaking")
        rows = rows.withColumns({"breaking": F.coalesce("breaking", F.lit(False)), "source": F.lower(F.trim(F.coalesce("source", F.lit("")))), "_run": F.col(run)})
        rows = rows.withColumn("_rank", F.row_number().over(sides.orderBy(*order, "candidate_id")))
        kept = ["_run", "category", "breaking", "candidate_id", "source", "story_key", "outcome", "_rank"]

        def run_fold(limit: int):
            return lambda group: folded(group.sort_values("_rank"), limit)

        def folded(group: pd.DataFrame, limit: int) -> pd.DataFrame:
            pools = {}
            for category, part in group.groupby("category"):
                side = lambda b, part=part: part[part["breaking"] == b].to_dict("records")
                pools[category] = tuple(Pool(side(b)[:limit], len(side(b)) > limit) for b in (True, False))
            tried, more = fold(pools, plan, cap)
            out = pd.DataFrame(tried, columns=["category", "candidate_id", "turn", "as_breaking", "result"])
            out["more"] = more
            if out.empty:
                out = pd.DataFrame([(None, None, 0, False, None, more)], columns=[f.split()[0] for f in _FIELDS.split(", ")])
            out.insert(0, "_run", group["_run"].iloc[0])
            return out

        kind, done, open_runs = dict(rows.dtypes)["_run"], None, None
        while True:
            # one rank more than is folded tells whether there is more
            some = rows.where(F.col("_rank") <= first + 1).select(*kept)
            some = some if open_runs is None else some.join(open_runs, "_run", "left_semi")
            now = scope.store(some.groupBy("_run").applyInPandas(run_fold(first), f"_run {kind}, {_FIELDS}"), "tried")
            finished = now.where("NOT more AND category IS NOT NULL").drop("more")
            done = finished if done is None else done.unionByName(finished)
            open_runs = now.where("more").select("_run").distinct()
            if open_runs.isEmpty():
                break
            first *= 2
        return scope.result(done.withColumnRenamed("_run", run), "publication")
