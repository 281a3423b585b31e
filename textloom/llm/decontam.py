"""Benchmark decontamination with suffix arrays of the training texts.

The training texts are read in shards (a few MB of text). Of each shard a suffix array is built over the words at which a
benchmark window could start; the suffixes of the benchmark items are looked up in it by binary search, which gives the
places of every verbatim match, and matches that go on are joined to the longest ones. The benchmark is the stated query
set: it is read in blocks of bounded size, and each block is held against all documents.

Words: A-Z in lower case, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``width`` consecutive words of an item; an item
of fewer words is one window. Null and empty texts have no words; an item without words has no window. Each row of the
documents gives one row. Repeated items count once by their item_id; a null item_id is left out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

WIDTH = 10
#: Bytes of benchmark text that the driver holds and sends to the executors at once.
BLOCK_BYTES = 16 << 20


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of about ``limit`` bytes; at least one, which may be empty."""
    ids, texts, size, some = [], [], 0, False
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    for item, text in rows.toLocalIterator(prefetchPartitions=False):
        if ids and size + len(text) > limit:
            yield ids, texts
            ids, texts, size, some = [], [], 0, True
        ids.append(item)
        texts.append(text)
        size += 4 * len(text)
    if ids or not some:
        yield ids, texts


class Suffixes:
    """The suffixes of a block of items, as numbers of words: what is searched for."""

    def __init__(self, ids: list[int], texts: list[str], width: int = WIDTH):
        text, at = W.utf8(pa.array(texts, pa.string()))
        words = W.Words(W.LOWER[text], at, W.ALNUM)
        # words are numbered from 1 in byte order; 0 is what no item has
        order = pc.sort_indices(words.distinct)
        self.vocabulary, number = words.distinct.take(order), np.zeros(len(words.distinct), np.int64)
        number[order.to_numpy(zero_copy_only=False)] = np.arange(1, len(number) + 1)
        numbers = number[words.codes]
        starts = words.window_starts(width)
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        starts = np.concatenate([starts, words.first[short]]).astype(np.int64)
        size = np.concatenate([np.full(len(starts) - len(short), width), words.counts[short]]).astype(np.int64)
        self.width, self.size = width, size
        self.item = np.array(ids, np.int64)[words.rows[starts]] if len(starts) else np.zeros(0, np.int64)
        self.offset = starts - words.first[words.rows[starts]] if len(starts) else starts
        padded = np.concatenate([numbers, np.zeros(width, np.int64)])
        self.rows = np.where(np.arange(width) < size[:, None], padded[starts[:, None] + np.arange(width)], 0)
        self.head = min(4, int(size.min())) if len(size) else 1
        self.heads = np.unique(self._head(self.rows))

    def _head(self, rows: np.ndarray) -> np.ndarray:
        """A hash of the first words, equal for equal ones: it only rules places out."""
        key = np.zeros(len(rows), np.uint64)
        for k in range(self.head):
            key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k].astype(np.uint64))
        return key

    def array_of(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """The shard's suffix array: the word places at which a window may start, in the order of the words that follow,
        with those words' numbers."""
        found = pc.index_in(words.distinct, value_set=self.vocabulary)
        number = np.where(pc.is_valid(found).to_numpy(zero_copy_only=False), pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1, 0)
        numbers = np.concatenate([number[words.codes], np.zeros(self.width, np.int64)])
        places = np.flatnonzero(numbers[: len(words)] > 0)
        last = words.first[1:][words.rows[places]]
        for k in range(1, self.head):
            on = (numbers[places + k] > 0) & (places + k < last)
            places, last = places[on], last[on]
        near = numbers[places[:, None] + np.arange(self.head)] if len(places) else np.zeros((0, self.head), np.int64)
        keys = self._head(near)
        at = np.minimum(np.searchsorted(self.heads, keys), max(len(self.heads) - 1, 0))
        places = places[self.heads[at] == keys] if len(self.heads) else places[:0]
        upto = np.arange(self.width)
        following = np.where(places[:, None] + upto < words.first[1:][words.rows[places]][:, None], numbers[places[:, None] + upto], 0)
        # a word that no item has ends the suffix
        following = np.where(np.minimum.accumulate(following > 0, axis=1), following, 0)
        order = np.lexsort(following.T[::-1]) if len(places) else np.zeros(0, np.int64)
        return places[order], following[order]

    def matches(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, word) for every place in the shard at which a window occurs, by binary search."""
        places, following = self.array_of(words)
        none = np.zeros(0, np.int64)
        if not len(places):
            return none, none
        near = np.flatnonzero(np.isin(self._head(self.rows), self._head(following)))
        low, high = np.zeros(len(near), np.int64), np.zeros(len(near), np.int64)
        for size in np.unique(self.size[near]).tolist():
            mine = self.size[near] == size
            # distinct prefixes in order, and where each begins in the suffix array
            cut = following[:, :size]
            begins = np.flatnonzero(np.concatenate([[True], (cut[1:] != cut[:-1]).any(axis=1)]))
            ends = np.concatenate([begins[1:], [len(places)]])
            at = _search(cut[begins], self.rows[near[mine], :size])
            hit = at >= 0
            low[mine] = np.where(hit, begins[np.maximum(at, 0)], 0)
            high[mine] = np.where(hit, ends[np.maximum(at, 0)], 0)
        n = high - low
        window = np.repeat(near, n)
        place = places[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return window, place


def _search(sorted_rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Binary search of whole rows, all at once; -1 where a row is not there."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(sorted_rows), np.int64)
    width = sorted_rows.shape[1]
    while (open_ := low < high).any():
        middle = (low + high) // 2
        rows = sorted_rows[np.minimum(middle, len(sorted_rows) - 1)]
        differ = rows != wanted
        first = np.argmax(differ, axis=1)
        k = np.arange(len(wanted))
        less = differ.any(axis=1) & (rows[k, first] < wanted[k, first])
        low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
    at = np.minimum(low, len(sorted_rows) - 1)
    return np.where((low < len(sorted_rows)) & (sorted_rows[at] == wanted).all(axis=1) & (width > 0), at, -1)


def _longest(suffixes: Suffixes, window: np.ndarray, place: np.ndarray):
    """Windows of one item that follow each other at following words, joined: (item, item word, word, words)."""
    item, offset, size = suffixes.item[window], suffixes.offset[window], suffixes.size[window]
    order = np.lexsort((offset, place - offset, item))
    item, offset, place, size = item[order], offset[order], place[order], size[order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (place[1:] - offset[1:] != place[:-1] - offset[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(item) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(item)]]).astype(np.int64)
    return item[begin], offset[begin], place[begin], (end - begin) - 1 + size[begin] if len(begin) else begin


_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))


def _found(block):
    """Adds what a block of items has in common with each text to its row's list of matches."""

    def run(batches):
        suffixes = block.value
        for batch in batches:
            for rows, text, at in W.slices(batch):
                words = W.Words(W.LOWER[text], at, W.ALNUM)
                item, item_word, place, n = _longest(suffixes, *suffixes.matches(words))
                row = words.rows[place] if len(place) else place
                order = np.argsort(row, kind="stable")
                found = pa.StructArray.from_arrays([pa.array(x[order], pa.int64()) for x in (item, item_word, place - words.first[row] if len(row) else place, n)], ["item_id", "item_word", "doc_word", "n_words"])
                offsets = np.searchsorted(row[order], np.arange(rows.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), found).cast(_MATCH)
                k = rows.schema.get_field_index("matches")
                old = rows.column(k)
                if len(old.flatten()):
                    lists = pa.array([a + b for a, b in zip(old.to_pylist(), lists.to_pylist())], _MATCH)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(rows.num_columns) if c != k), lists], names=[*(f.name for f in rows.schema if f.name != "matches"), "matches"])

    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text and ``matches``, an array of (item_id, item_word, doc_word, n_words): the longest verbatim matches of
    at least a window."""
    spark = docs.sparkSession
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = out.withColumn("matches", F.expr("cast(array() as array<struct<item_id:long,item_word:long,doc_word:long,n_words:long>>)"))
    for ids, texts in blocks(benchmark):
        block = spark.sparkContext.broadcast(Suffixes(ids, texts, width))
        out = out.mapInArrow(_found(block), out.schema)
    return out


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64())])


def _report(batches):
    for batch in batches:
        for rows, text, at in W.slices(batch):
            counts = W.Words(W.LOWER[text], at, W.ALNUM).counts.tolist()
            hit, items, longest = [], [], []
            for n, matches in zip(counts, rows.column(2).to_pylist()):
                spans = np.array([(m["doc_word"], m["n_words"]) for m in matches], np.int64).reshape(-1, 2)
                hit.append(int(W.covered(n, spans[:, 0], spans[:, 1]).sum()) if len(spans) else 0)
                items.append(sorted({str(m["item_id"]) for m in matches}))
                longest.append(int(spans[:, 1].max()) if len(spans) else 0)
            columns = (counts, hit, [len(i) for i in items], [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], [h > 0 for h in hit], longest)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_REPORT)[1:]))], schema=_REPORT)


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row a document: how many words are in matches, of which items, and the longest match."""
    return find_matches(docs, benchmark, width).mapInArrow(_report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without a match, with all their columns."""
    spark = docs.sparkSession
    out = docs
    for ids, texts in blocks(benchmark):
        block = spark.sparkContext.broadcast(Suffixes(ids, texts, width))
        out = out.mapInArrow(_clean(block), docs.schema)
    return out


def _clean(block):
    def run(batches):
        for batch in batches:
            for rows, text, at in W.slices(batch):
                words = W.Words(W.LOWER[text], at, W.ALNUM)
                place = block.value.matches(words)[1]
                hit = np.zeros(rows.num_rows, bool)
                hit[words.rows[place]] = True
                yield rows.filter(pa.array(~hit))

    return run
