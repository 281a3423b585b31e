"""Exact repeat search over a corpus, slice by slice.

A slice is a few MB of whole texts, kept as one compressed row. A search sends keys (hashes of windows) from every slice to
buckets by hash, each distinct key once a slice, however often it occurs there. A bucket answers each slice with a bit per
key. So a passage in a third of all documents costs one key a slice, no group of copies is ever gathered in one task, and
buckets hold even shares whatever the text. The number of buckets follows the bytes of text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import Scope, free_name, new_folder

#: A null doc_id comes after all others: it takes nothing from other documents.
NO_ID = np.iinfo(np.int64).max
SLICE_BYTES = BUCKET_BYTES = 2 << 20

_SLICE = pa.schema([("slice_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.binary()), ("text", pa.binary()), ("rest", pa.binary()), ("size", pa.int64())])
_COLUMNS = "slice_id long, doc_ids array<long>, offsets binary, text binary, rest binary, size long"
_SENT = pa.schema([("bucket", pa.int32()), ("slice_id", pa.int64()), ("payload", pa.binary())])
_ANSWER = pa.schema([("slice_id", pa.int64()), ("bucket", pa.int32()), ("reply", pa.binary())])
SENT, ANSWER = "bucket int, slice_id long, payload binary", "slice_id long, bucket int, reply binary"


def _cut(batches):
    """Rows of (doc_id, text, other columns) to slices; the other columns are kept as an Arrow stream."""
    compressor, part, count, size = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []

    def row():
        nonlocal count, held, size
        ids = pa.concat_arrays([h[0] for h in held])
        text = np.concatenate([h[1] for h in held])
        ends = np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        rest = None
        if held[0][3].num_columns:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0][3].schema) as out:
                for h in held:
                    out.write_batch(h[3])
            rest = compressor.compress(sink.getvalue().to_pybytes())
        slice_id, count, size, held = (part << 32) + count, count + 1, 0, []
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([slice_id]), lists, *(pa.array([x], pa.binary()) for x in (offsets.tobytes(), compressor.compress(text.tobytes()), rest)), pa.array([len(text)])], schema=_SLICE)

    for batch in batches:
        for rows, text, at in W.slices(batch, 1, limit=SLICE_BYTES // 4):
            other = pa.RecordBatch.from_arrays(rows.columns[2:], schema=pa.schema(list(rows.schema)[2:]))
            held.append((rows.column(0).cast(pa.int64()), text.copy(), at, other))
            size += len(text)
            if size >= SLICE_BYTES:
                yield row()
    if held:
        yield row()


class Slice:
    """One row of the slice table with the answers it has got."""

    def __init__(self, slice_id: int, doc_ids: pa.Array, offsets: bytes, text: bytes, rest: bytes | None, answers: list | None):
        self.id, self.doc_ids, self._rest = slice_id, doc_ids, rest
        self.at = np.frombuffer(offsets, np.int64)
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        self.docs = doc_ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self._answers = {(a["level"], a["bucket"]): a["reply"] for a in answers or ()}

    def answer(self, level: int, bucket: int) -> bytes:
        return self._answers.get((level, bucket), b"")

    def answers(self, level: int) -> list[bytes]:
        """All answers of a level."""
        return [reply for (of, _), reply in self._answers.items() if of == level]

    def rest(self) -> pa.Table:
        """The other columns of its rows, and ``text`` as an empty string or null."""
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self._rest)).read_all()

    def bits(self, level: int, counts: np.ndarray) -> np.ndarray:
        """The answers of a level in the order in which the keys were sent."""
        out = [np.unpackbits(np.frombuffer(self._answers[level, b], np.uint8), count=n) for b, n in enumerate(counts.tolist()) if n]
        return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def read_slices(batches: Iterator[pa.RecordBatch], with_more: bool = False) -> Iterator:
    """The slices of a slice table with their answers; ``with_more``: each with the list that stands in place of answers."""
    for batch in batches:
        answers = batch.column(6) if batch.num_columns > 6 else None
        for k in range(batch.num_rows):
            ids, (offsets, text, rest) = batch.column(1)[k].values, (batch.column(c)[k].as_py() for c in (2, 3, 4))
            piece = Slice(batch.column(0)[k].as_py(), ids, offsets, text, rest, answers[k].as_py() if answers is not None and not with_more else None)
            yield (piece, answers.slice(k, 1).flatten()) if with_more else piece


def bucket_counts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """How many of the sorted 64-bit keys are in each bucket: buckets are ranges of the key's upper half."""
    edges = (((np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets)) << np.uint64(32)
    at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    return np.diff(at).astype(np.int64)


def sent(slice_id: int, counts: np.ndarray, payload: Callable[[int, int], bytes]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that gets something; payload(first, last) packs a run of keys."""
    at = np.concatenate([[0], np.cumsum(counts)])
    held = np.flatnonzero(counts)
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(np.full(len(held), slice_id)), pa.array([payload(int(at[b]), int(at[b + 1])) for b in held], pa.binary())], schema=_SENT)


class SliceTable:
    """The slices of a table of documents, and the answers they have got. Everything stored goes with the scope."""

    def __init__(self, docs: DataFrame, scope: Scope, keep_columns: bool = False):
        self.spark, self.scope = docs.sparkSession, scope
        named = [F.col("doc_id").cast("long").alias(free_name(docs, "slice_doc_id")), F.col("text").cast("string").alias(free_name(docs, "slice_text"))]
        # of the text itself nothing is kept twice, but whether it is null
        kept = [F.left(c, F.lit(0)).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns] if keep_columns else []
        texts = docs.select(*named, *kept)
        # a bucketed table: the slices are dealt by slice_id once, and the joins with their answers move answers alone
        parts, name, folder = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"slices_{uuid.uuid4().hex}", new_folder(self.spark, "slices")
        scope.holds(path=folder, table=name)
        dealt = texts.mapInArrow(_cut, _COLUMNS).repartition(parts, "slice_id")
        dealt.write.bucketBy(parts, "slice_id").option("compression", "zstd").option("path", folder).saveAsTable(name)
        self.df = self.spark.table(name)
        self.size = self.df.agg(F.sum("size")).first()[0] or 0
        #: Shares of a search's keys; a bucket holds about those of BUCKET_BYTES of text.
        self.buckets = max(8, -(-self.size // BUCKET_BYTES))
        self.answers: DataFrame | None = None

    def rows(self) -> DataFrame:
        """The slices, with all answers so far."""
        if self.answers is None:
            return self.df
        got = self.answers.groupBy("slice_id").agg(F.collect_list(F.struct("level", "bucket", "reply")).alias("answers"))
        return self.df.join(got, "slice_id", "left")

    def add(self, level: int, replies: DataFrame) -> None:
        """Answers (slice_id, bucket, reply) of a level that some other search has found."""
        replies = replies.select("slice_id", F.col("bucket").cast("int").alias("bucket"), "reply", F.lit(level).alias("level"))
        self.answers = replies if self.answers is None else self.answers.unionByName(replies)

    def ask(self, level: int, send: Callable, answer: Callable, label: str) -> None:
        """One search: ``send`` maps slices to SENT rows, ``answer`` maps a bucket's rows to ANSWER rows."""
        asked = self.rows().mapInArrow(send, SENT)
        self.add(level, self.scope.store(asked.groupBy("bucket").applyInArrow(_as_tables(answer), ANSWER), label))


def _as_tables(answer: Callable):
    def run(table: pa.Table) -> pa.Table:
        payloads = table.column("payload").to_pylist()
        return pa.Table.from_arrays([table.column("slice_id"), table.column("bucket"), pa.chunked_array([pa.array(answer(payloads), pa.binary())])], schema=_ANSWER)

    return run


def in_several(payloads: list[bytes]) -> list[bytes]:
    """For slices' distinct 64-bit keys: which are in more than one slice."""
    sizes = [len(p) // 8 for p in payloads]
    keys = np.frombuffer(b"".join(payloads), np.uint64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    several = np.zeros(len(keys), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    return [np.packbits(x).tobytes() for x in np.split(several, np.cumsum(sizes)[:-1])]


def distinct_keys(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's number among them, and which are in more than one document here."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    several = np.zeros(len(first), bool)
    if len(first):
        several = np.maximum.reduceat(docs[order], first) != np.minimum.reduceat(docs[order], first)
    return ordered[new], number, several
