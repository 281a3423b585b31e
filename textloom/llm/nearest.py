"""Exact nearest neighbours by cosine: a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks by a hash; a tile is one block of either side, so the grid of tiles covers
every pair and each tile is a bounded piece of work anywhere. In a tile unit vectors are rounded to int8. The product of
the codes is exact, and the parts lost in rounding bound how far a cosine can be from it:

    |cos(u, v) - su sv (cu . cv)| <= |v - sv cv| + |u - su cu| (1 + |v - sv cv|)

Pairs whose upper bound stays under what the query has already found are done with; the others' cosines are computed on the
original vectors in double precision and merged into the query's heap. The heaps of a query's tiles are merged after.

Equal vectors are one candidate and one query: a vector that a third of all rows share is searched for once, and only its
smallest ids can be anyone's neighbours."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scope

#: Bytes of vectors in a block of either side; with two blocks, products and bounds a tile needs a few times as much.
BLOCK_BYTES = 8 << 20
#: Rows of a block at most, and candidates that are multiplied at once.
BLOCK_ROWS, STEP = 4096, 1024
#: Dimensions over which the product of two int8 codes, taken in float32, stays exact.
EXACT_DIMS = (1 << 24) // (127 * 127)
#: Beyond the bounds of exact arithmetic: what rounding in float32 can add.
SLACK = 2e-6
#: Heaps that are merged at once.
MERGED = 64

_FOUND = "array<struct<minus:double,vec_id:bigint>>"


def _numbers(found: pa.Array, dims: int) -> np.ndarray:
    """List column of equal lengths to a matrix in double precision."""
    return found.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(vectors, vectors))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matching rows, added up in order of the dimensions: the same number for the same rows anywhere."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def cosines(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    return dots(a, b) / (a_size * b_size)


def quantised(vectors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, the scale of each, and the length of what rounding lost."""
    unit = vectors / sizes[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    return codes.astype(np.int8), scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of int8 codes: exact, since partial sums of at most ``EXACT_DIMS`` terms fit a float32."""
    out = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= EXACT_DIMS else np.float64)
    for j in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, j : j + EXACT_DIMS].astype(np.float32) @ b[:, j : j + EXACT_DIMS].astype(np.float32).T
    return out


class Heaps:
    """For each query of a tile the best ``k`` candidates so far: highest cosine first, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.score, self.first, self.at = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max), np.full((queries, k), -1, np.int64)

    @property
    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def merge(self, query: np.ndarray, score: np.ndarray, first: np.ndarray, at: np.ndarray) -> None:
        """Pairs by query, in any order."""
        k = self.score.shape[1]
        touched, query = np.unique(query, return_inverse=True)
        row = np.concatenate([query, np.repeat(np.arange(len(touched)), k)])
        score, first, at = (np.concatenate([x, y[touched].ravel()]) for x, y in ((score, self.score), (first, self.first), (at, self.at)))
        order = np.lexsort((first, -score, row))
        begins = np.searchsorted(row[order], np.arange(len(touched)))
        take = order[(begins[:, None] + np.arange(k)).ravel()]
        self.score[touched], self.first[touched], self.at[touched] = (x[take].reshape(-1, k) for x in (score, first, at))


def searched(queries: np.ndarray, candidates: np.ndarray, first: np.ndarray, k: int) -> Heaps:
    """The ``k`` candidates nearest each query in one tile."""
    heaps = Heaps(len(queries), k)
    q_size, c_size = lengths(queries), lengths(candidates)
    (q, q_scale, q_lost), (c, c_scale, c_lost) = quantised(queries, q_size), quantised(candidates, c_size)
    for j in range(0, len(c), STEP):
        part = slice(j, j + STEP)
        about = tile_product(q, c[part]) * q_scale[:, None].astype(np.float32) * c_scale[part].astype(np.float32)
        off = (c_lost[part] + q_lost[:, None] * (1 + c_lost[part]) + SLACK).astype(np.float32)
        floor = heaps.worst
        if about.shape[1] > k:
            floor = np.maximum(floor, np.partition(about - off, -k, axis=1)[:, -k])
        row, column = np.nonzero(about + off >= (floor - SLACK)[:, None])
        for i in range(0, len(row), 1 << 16):  # bounded copies of vectors, however many pairs survive
            r, at = row[i : i + (1 << 16)], column[i : i + (1 << 16)] + j
            heaps.merge(r, cosines(queries[r], candidates[at], q_size[r], c_size[at]), first[at], at)
    return heaps


def _tile(k: int):
    """A tile's blocks to a row a query: its best rows in the tile."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        empty = pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "found": pa.array([], pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())])))})
        if not left.num_rows or not right.num_rows:
            return empty
        dims = left["dims"][0].as_py()
        ids = right["ids"].to_pylist()
        heaps = searched(_numbers(left["vector"].chunk(0), dims), _numbers(right["vector"].chunk(0), dims), np.array([x[0] for x in ids]), k)
        found = []
        for scores, at in zip(heaps.score, heaps.at, strict=True):
            rows = ((-s, i) for s, a in zip(scores.tolist(), at.tolist(), strict=True) if a >= 0 for i in ids[a])
            found.append([{"minus": m, "vec_id": i} for m, i in heapq.nsmallest(k, rows)])
        part = pa.array([right["part"][0].as_py()] * left.num_rows, pa.int32())
        return pa.table({"h1": left["h1"], "h2": left["h2"], "part": part, "found": pa.array(found, empty["found"].type)})

    return run


def _merged(heaps: DataFrame, k: int, by: list[str | Column]) -> DataFrame:
    """One heap of the heaps of a group; each holds ``k`` rows at most."""
    return heaps.groupBy("h1", "h2", *by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, vector, dims) of the rows that can have a cosine: an id, and finite numbers that aren't all zero.

    Of rows that share a vec_id the one with the smallest vector counts."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = rows.filter(~F.exists("vector", odd) & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: the ``k`` nearest other rows, as (query_id, rank, vec_id, score).

    Exact: recall is 1. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
    without an id; vectors of different dimensions aren't compared. Ties go to the smaller id. An empty table, or a query
    without candidates, gives no rows. Components are single-precision, so squares don't overflow. Other columns are not looked at."""
    spark, most = vectors.sparkSession, k + 1  # a query's own row is among the nearest of its vector
    with Scope(spark) as scope:
        rows = usable(vectors, id, vector).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), F.col("vector"))})
        rows = scope.store(rows, "vectors")
        asked = F.col("vec_id") % every == 0
        # of equal vectors the smallest ids: cut before the shuffle, so none meets its copies in one task
        ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("_n") <= most)
        classes = ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"), F.first("dims").alias("dims"))
        classes = scope.store(classes, "vector-classes")
        wanted = rows.filter(asked).select("h1", "h2").distinct()
        queries = scope.store(classes.select("h1", "h2", "vector", "dims").join(wanted, ["h1", "h2"], "left_semi"), "query-vectors")

        asking = queries.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        many, wide = classes.agg(F.count(F.lit(1)), F.max("dims")).first()
        block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (wide or 1))))
        down = -(-asking // block)
        # as many tiles as there are tasks, as long as blocks stay worth a product
        across = max(-(-(many or 1) // block), min(-(-spark.sparkContext.defaultParallelism // down), -(-(many or 1) // STEP)))
        tile = ["dims", "row", "part"]
        on_left = queries.withColumn("row", F.pmod("h1", F.lit(down)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        on_right = classes.withColumn("part", F.pmod("h2", F.lit(across)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
        heaps = on_left.groupBy(*tile).cogroup(on_right.groupBy(*tile)).applyInArrow(_tile(most), f"h1 long, h2 long, part int, found {_FOUND}")
        heaps = _merged(heaps, most, [F.floor(F.col("part") / MERGED).alias("part")])
        nearest = scope.store(_merged(heaps.select("h1", "h2", "found"), most, []), "nearest")

        out = rows.filter(asked).select("h1", "h2", F.col("vec_id").alias("query_id")).join(nearest, ["h1", "h2"])
        others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        out = out.select("query_id", F.posexplode(others).alias("rank", "_x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "_x.vec_id", (-F.col("_x.minus")).alias("score"))
        return scope.result(out, "neighbours")
