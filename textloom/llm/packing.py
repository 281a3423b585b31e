"""Packing of token sequences by cutting-stock column generation.

Documents become token ids, pieces of at most ``capacity`` ids, and a histogram of piece lengths on a grid. A linear
program over patterns (how many pieces of each length fill one sequence) is solved by column generation: a knapsack
dynamic program prices new patterns. The plan has at most a few patterns per length class, whatever the input, so the
driver sees the histogram alone; Spark ranks the pieces of each class and deals them to the plan's sequences.

Null or empty texts are a document of the closing id alone; repeated rows and equal doc_ids are packed once each; an empty
table gives no rows. Only ``doc_id`` and ``text`` are read, so extra columns can't clash."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import Scope

CAPACITY = 2048
GRID = 8
#: Words remembered by a Python worker; beyond, it starts afresh. It bounds memory alone, not what is encoded.
REMEMBERED = 1_500_000


def solve_patterns(demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often to use each, so that every size's demand is met exactly.

    ``demand[s]`` pieces have size ``s``; sizes run from 1 to ``capacity``. Returns [({size: pieces}, sequences)]."""
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    need = demand[sizes].astype(float)
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ need
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        column, value = _best_pattern(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(direction > 1e-9, x / direction, np.inf)
        leaves = int(np.argmin(ratios))
        step = ratios[leaves]
        x = np.maximum(x - step * direction, 0)
        x[leaves] = step
        columns[:, leaves] = column
        row = inverse[leaves] / direction[leaves]
        inverse -= np.outer(direction, row)
        inverse[leaves] = row
    plan: list[tuple[dict[int, int], int]] = []
    left = demand[sizes].astype(np.int64).copy()
    for k in np.argsort(-x, kind="stable"):
        items = columns[:, k].astype(np.int64)
        held = items > 0
        times = min(int(x[k] + 1e-6), int((left[held] // items[held]).min()) if held.any() else 0)
        if times > 0:
            left -= times * items
            plan.append(({int(s): int(n) for s, n in zip(sizes[held], items[held])}, times))
    return plan + _first_fit(dict(zip(sizes.tolist(), left.tolist())), capacity)


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack: the most valuable pieces that fit."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(sizes, room, "right"))
        best[room] = best[room - 1]
        if fits:
            values = best[room - sizes[:fits]] + prices[:fits]
            k = int(np.argmax(values))
            if values[k] > best[room] + 1e-12:
                best[room], took[room] = values[k], k
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        k = took[room]
        if k < 0:
            room -= 1
        else:
            column[k] += 1
            room -= int(sizes[k])
    return column, float(best[capacity])


def _first_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """What rounding down has left over, largest pieces first into each sequence, as long as the same fill repeats."""
    plan = []
    while any(left.values()):
        room, fill = capacity, {}
        for s in sorted((s for s, n in left.items() if n), reverse=True):
            n = min(left[s], room // s)
            if n:
                fill[s], room = n, room - n * s
        times = min(left[s] // n for s, n in fill.items())
        for s, n in fill.items():
            left[s] -= n * times
        plan.append((fill, times))
    return plan


class _Encoder:
    """Token ids of single words. The tokenizer drops white space, so a text's ids are those of its words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens that the tokenizer looks for before it takes texts apart.
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.ids, self.used = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(1 << 16, np.int32), 0

    def spans(self, distinct: pa.Array) -> np.ndarray:
        """Where in ``ids`` each word's ids are: first, and how many."""
        import xxhash

        if len(self.keys) > REMEMBERED:
            self.forget()
        listed = distinct.to_pylist()
        keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in listed), np.uint64, len(listed))
        where = np.searchsorted(self.keys, keys)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            found, new = np.unique(keys[new], return_index=True)[0], new[np.unique(keys[new], return_index=True)[1]]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast([listed[k].decode("utf-8", "replace") for k in new], add_special_tokens=False)]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            total = int(sizes.sum())
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
            self.ids[self.used : self.used + total] = np.fromiter((i for e in encoded for i in e), np.int32, total)
            spans = np.stack([self.used + np.cumsum(sizes) - sizes, sizes], 1)
            self.used += total
            to = np.searchsorted(self.keys, found)
            self.keys, self.at = np.insert(self.keys, to, found), np.insert(self.at, to, spans, 0)
            where = np.searchsorted(self.keys, keys)
        return self.at[where]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


#: Punctuation that the tokenizer parts from an ASCII letter before it in any case.
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b",.;:!?")] = True


def _words(text: np.ndarray, at: np.ndarray) -> W.Words:
    """Words in lower case, as the tokenizer reads them; closing punctuation after an ASCII letter is a word of its own."""
    text = W.LOWER[text]
    found = W.Words(text, at)
    if not len(found):
        return found
    closing, letter = _CLOSING[text], (text >= 0x61) & (text <= 0x7A)
    # the last byte of each word that isn't closing punctuation
    last = np.maximum.accumulate(np.where(closing, -1, np.arange(len(text))))[found.ends - 1]
    cut = (last >= found.starts) & (last < found.ends - 1) & letter[np.maximum(last, 0)]
    if not cut.any():
        return found
    out = W.Words.__new__(W.Words)
    starts = np.concatenate([found.starts, last[cut] + 1])
    order = np.argsort(starts, kind="stable")
    ends = np.where(cut, last + 1, found.ends)
    out.starts, out.ends = starts[order], np.concatenate([ends, found.ends[cut]])[order]
    out.first = np.searchsorted(out.starts, at)
    out.counts = np.diff(out.first)
    out.rows = np.repeat(np.arange(len(at) - 1), out.counts)
    out.text, out._inside = text, W.PLAIN[text]
    return out


def token_ids(text: np.ndarray, at: np.ndarray, path: str, closing_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts in a row, each closed by ``closing_id``, and the offsets of the texts."""
    encoder, found = _encoder(path), _words(text, at)
    spans = np.concatenate([encoder.spans(found.distinct), [[-1, 1]]])
    codes = np.insert(found.codes, found.first[1:], len(spans) - 1)
    counts = spans[codes, 1]
    ends = np.cumsum(counts)
    ids = np.repeat(spans[codes, 0] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    ids = np.where(ids < 0, closing_id, encoder.ids[np.maximum(ids, 0)]) if len(ids) else np.zeros(0, np.int32)
    closes = found.first[1:] + np.arange(len(at) - 1)
    closing = ends[closes] - 1
    ids[closing] = closing_id
    to = np.concatenate([[0], closing + 1])
    raw = text.tobytes()
    low = raw.lower()
    if any(a in low for a in encoder.added):
        # such texts go to the tokenizer whole
        parts = [ids[a:b] for a, b in zip(to[:-1], to[1:])]
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if any(x in low[a:b] for x in encoder.added):
                parts[k] = np.array([*encoder.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, closing_id], np.int64)
        ids, to = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return ids.astype("<u4"), to


def _pieces(path: str, closing_id: int, capacity: int, grid: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("place", pa.int64())])

    def run(batches):
        part, placed = TaskContext.get().partitionId(), np.zeros(capacity // grid + 2, np.int64)
        for batch in batches:
            for rows, text, at in W.slices(batch):
                ids, to = token_ids(text, at, path, closing_id)
                n = np.diff(to)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, n[doc] - start)
                raw, begin = ids.tobytes(), (to[doc] + start) * 4
                crc = [zlib.crc32(memoryview(raw)[b : b + 4 * k]) for b, k in zip(begin.tolist(), length.tolist())]
                size = -(-length // grid)
                order = np.argsort(size, kind="stable")
                place = np.empty(len(size), np.int64)
                place[order] = np.arange(len(size)) - np.searchsorted(size[order], size[order])
                place += placed[size]
                placed += np.bincount(size, minlength=len(placed))
                ids_of = rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids_of.cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip((start, length, crc, n[doc], np.full(len(doc), part), size, place), list(schema)[1:]))], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer_path: str, closing_id: int = 1, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens."""
    spark = docs.sparkSession
    with Scope(spark) as scope:
        made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _pieces(tokenizer_path, closing_id, capacity, grid), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, size int, place long"
        )
        pieces = scope.store(made, "pieces")
        counts = pieces.groupBy("part", "size").count()
        before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        ranked = pieces.join(before.select("part", "size", F.coalesce("before", F.lit(0)).alias("before")), ["part", "size"]).withColumn("rank", F.col("before") + F.col("place"))
        # at most capacity / grid rows
        demand = np.zeros(capacity // grid + 1, np.int64)
        for row in pieces.groupBy("size").count().collect():
            demand[row["size"]] = row["count"]
        plan = _plan_table(spark, solve_patterns(demand, capacity // grid))
        # the plan has a few rows a pattern, and about as many patterns as there are sizes at most
        placed = ranked.join(F.broadcast(plan), (ranked["size"] == plan["of"]) & (ranked["rank"] >= plan["low"]) & (ranked["rank"] < plan["high"])).withColumn("turn", F.col("rank") - F.col("low"))
        placed = placed.withColumn("sequence_id", F.col("base") + F.floor(F.col("turn") / F.col("each")).cast("long"))
        of = Window.partitionBy("sequence_id")
        upto = of.orderBy(F.desc("size"), F.col("turn")).rowsBetween(Window.unboundedPreceding, -1)
        return scope.result(placed.select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
            F.coalesce(F.sum("length").over(upto), F.lit(0)).cast("long").alias("offset"),
            F.sum("length").over(of).cast("long").alias("sequence_tokens"),
        ), "packed")


def _plan_table(spark: SparkSession, plan: list[tuple[dict[int, int], int]]) -> DataFrame:
    used: dict[int, int] = {}
    rows, base = [], 0
    for items, times in plan:
        for size, each in items.items():
            low = used.get(size, 0)
            used[size] = low + each * times
            rows.append((size, low, used[size], each, base))
        base += times
    frame = pd.DataFrame(rows, columns=["of", "low", "high", "each", "base"])
    return spark.createDataFrame(frame.astype("int64"), "of long, low long, high long, each long, base long")
