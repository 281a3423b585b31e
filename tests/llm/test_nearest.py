"""Block matrix search against brute force over all pairs."""

import numpy as np
import pytest

from textloom.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, rank string, h1 int, found double"


def plain(rows, every, k):
    ok, best = {}, {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = tuple(np.float32(v).tolist())
        ok[i] = min(v, ok.get(i, v))
    for q in ok:
        if q % every == 0:
            found = []
            for c in ok:
                if c != q and len(ok[c]) == len(ok[q]):
                    a, b = np.array([ok[q]]), np.array([ok[c]])
                    found.append((-nearest.cosines(a, b, nearest.lengths(a), nearest.lengths(b))[0], c))
            best[q] = sorted(found)[:k]
    return sorted((q, r + 1, c, -s) for q, x in best.items() for r, (s, c) in enumerate(x))


def held(spark, rows, every=5, k=3):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], "own", 1, 2.0) for i, v in rows]
    got = nearest.search(spark.createDataFrame(data, SCHEMA).repartition(4), every, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, every, k)


def random_rows(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.normal(size=dims).tolist()) for i in rng.permutation(n * 3)[:n]]


def test_awkward_rows(spark):
    rows = random_rows(60, 8)
    same, other = [1.0, 2, 3, 4, 5, 6, 7, 8], [3e38] * 8
    rows += [(200 + i, same) for i in range(30)] + [(300 + i, [2 * x for x in same]) for i in range(4)] + [(400 + i, [-x for x in same]) for i in range(6)]
    rows += [(500, None), (505, []), (510, [0.0] * 8), (515, [float("nan")] * 8), (520, [float("inf")] + same[1:]), (525, [None] + same[1:]), (None, same)]
    rows += [(530, other), (531, [1e-40] * 8), (535, [0.0, -0.0, 0, 0, 0, 0, 0, 1]), (540, same), (540, same), (545, same), (545, [9.0] + same[1:])]
    rows += [(600, [1.0]), (605, [1.0, 2.0]), (606, [2.0, 1.0])]
    held(spark, rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nearest, "STEP", 16)
    monkeypatch.setattr(nearest, "MERGED", 2)
    held(spark, random_rows(300, 5) + [(3000 + i, [1.0, 1, 1, 1, 1 + i * 1e-7]) for i in range(100)], every=2)


def test_one_vector_in_a_third_of_the_rows(spark):
    held(spark, random_rows(200, 6) + [(5000 + i, [1.0] * 6) for i in range(100)])


def test_nothing_to_find(spark):
    held(spark, [])
    held(spark, [(5, [1.0, 2.0])])
    held(spark, [(1, [1.0, 2.0])])


@pytest.mark.parametrize("dims", [3, 64, 2500])
def test_bounds_hold_and_products_are_exact(dims):
    rng = np.random.default_rng(dims)
    a, b = rng.normal(size=(50, dims)) ** 3, rng.standard_cauchy(size=(70, dims))
    (qa, sa, ea), (qb, sb, eb) = nearest.quantised(a, nearest.lengths(a)), nearest.quantised(b, nearest.lengths(b))
    product = nearest.tile_product(qa, qb)
    assert (product == qa.astype(np.int64) @ qb.astype(np.int64).T).all()
    true = (a / nearest.lengths(a)[:, None]) @ (b / nearest.lengths(b)[:, None]).T
    assert (abs(true - product * sa[:, None] * sb) <= eb + ea[:, None] * (1 + eb) + 1e-12).all()


def test_few_pairs_survive():
    rng = np.random.default_rng(4)
    queries, candidates, seen = rng.normal(size=(50, 64)), rng.normal(size=(5000, 64)), []
    real = nearest.cosines
    try:
        nearest.cosines = lambda a, *rest: seen.append(len(a)) or real(a, *rest)
        nearest.searched(queries, candidates, np.arange(5000), 6)
    finally:
        nearest.cosines = real
    assert sum(seen) < 0.05 * 50 * 5000
