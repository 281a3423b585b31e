"""Repeated byte strings, found in suffix arrays that are built by external induced sorting.

Every 50-byte window holds a sampled 16-byte gram, the one with the least hash of all in it. Windows whose gram occurs in
one document alone can't repeat elsewhere. The others go, in runs of bytes, to the shard that their gram names, so equal
windows meet in one shard. There equal runs are merged, and runs that agree with no other one in the 33 bytes on either side of
their gram are told apart. Of the rest a shard sorts the suffixes by induction: positions of the leftmost smaller-type suffixes are
sorted by a first round of induction over their substrings and by their names, and the second round induces all others.
Both rounds move positions through queues, one a byte value, that go to disk beyond a memory budget: as positions arrive
in the order of their suffixes, a queue a value is the priority queue. Neighbours in the array that share 50 bytes are one
string, and every occurrence in a document that isn't the string's smallest is removed.

Null and empty texts have no bytes. Each row gives one row; rows with one doc_id take nothing from each other; a null
doc_id comes last; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import words as W
from .shared import Scope
from .slices import Slice, SliceTable, bucket_counts, distinct_keys, in_several, read_slices, sent

WIDTH = 50
GRAM = 16
#: A window holds its gram and as many bytes more on one side at least; both together are what runs must agree on.
BESIDE = (WIDTH - GRAM + 1) // 2
#: Buckets of text whose keys are searched together, and whose runs go in one row: rows are slices times buckets over this.
KEYS_OF, RUNS_OF = 8, 4
#: Shards that a row of runs is split into: they are sorted one after the other, so that memory is a shard's.
SHARDS = 16
#: Bytes of positions that a round of induction holds in memory before its queues go to disk.
QUEUE_BYTES = 64 << 20


class BucketQueues:
    """A queue of positions for each byte value; what doesn't fit the budget is in files, in order."""

    def __init__(self, values: int, budget: int, folder: str):
        self.held: list[list[np.ndarray]] = [[] for _ in range(values)]
        self.filed, self.size, self.budget, self.folder = [False] * values, 0, budget, folder

    def push(self, value: int, positions: np.ndarray) -> None:
        self.held[value].append(positions)
        self.size += positions.nbytes
        if self.size > self.budget:
            for v, parts in enumerate(self.held):
                if parts:
                    with open(os.path.join(self.folder, str(v)), "ab") as out:
                        for part in parts:
                            part.tofile(out)
                    self.held[v], self.filed[v] = [], True
            self.size = 0

    def push_all(self, values: np.ndarray, positions: np.ndarray) -> None:
        """Positions in the order of their suffixes, each to its value's queue."""
        order = np.argsort(values, kind="stable")
        values, positions = values[order], positions[order]
        cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else []
        for a, b in zip(cuts, [*cuts[1:], len(values)]):
            self.push(int(values[a]), positions[a:b])

    def pop(self, value: int) -> np.ndarray:
        parts = self.held[value]
        self.size -= sum(p.nbytes for p in parts)
        self.held[value] = []
        if self.filed[value]:
            path = os.path.join(self.folder, str(value))
            parts = [np.fromfile(path, np.int32), *parts]
            os.remove(path)
            self.filed[value] = False
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _induce(text: np.ndarray, larger: np.ndarray, seeds: list[np.ndarray], values: int, budget: int) -> list[np.ndarray]:
    """All suffixes in order, a bucket a first value, from the seeds in order (by bucket)."""
    with tempfile.TemporaryDirectory() as folder:
        queues = BucketQueues(values, budget, folder)
        ups: list[np.ndarray] = []
        for value in range(values):
            turn, done = queues.pop(value), []
            while len(turn):
                done.append(turn)
                before = turn[turn > 0] - 1
                before = before[larger[before]]
                first = text[before]
                turn = before[first == value]
                queues.push_all(first[first != value], before[first != value])
            if len(seeds[value]):
                before = seeds[value][seeds[value] > 0] - 1
                before = before[larger[before]]
                queues.push_all(text[before], before)
            ups.append(np.concatenate(done) if done else np.zeros(0, np.int32))
    with tempfile.TemporaryDirectory() as folder:
        queues = BucketQueues(values, budget, folder)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * values
        for value in range(values - 1, -1, -1):
            turn, done = queues.pop(value), []
            while len(turn):
                done.append(turn)
                before = turn[turn > 0] - 1
                before = before[~larger[before]]
                first = text[before]
                turn = before[first == value]
                queues.push_all(first[first != value], before[first != value])
            down = ups[value][::-1]
            before = down[down > 0] - 1
            before = before[~larger[before]]
            queues.push_all(text[before], before)
            out[value] = np.concatenate([ups[value], *(d[::-1] for d in reversed(done))]) if done else ups[value]
    return out


def suffix_array(raw: np.ndarray, depth: int, budget: int = QUEUE_BYTES) -> np.ndarray:
    """The positions of ``raw`` (bytes) in the order of their suffixes; suffixes that agree on ``depth`` bytes may be in
    any order."""
    if len(raw) == 0:
        return np.zeros(0, np.int32)
    text = np.concatenate([raw.astype(np.int16) + 1, [0]]).astype(np.int16)
    n = len(text)
    # a suffix is of the larger type if it is greater than the one after it
    step = np.flatnonzero(text[1:] != text[:-1])
    larger = np.zeros(n, bool)
    upto = np.concatenate([[0], step + 1])
    larger[: int(step[-1]) + 1] = np.repeat(text[step] > text[step + 1], np.diff(upto))
    seeds = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    seeds = seeds.astype(np.int32)
    if len(seeds) > 1:
        by_value = np.split(seeds[np.argsort(text[seeds], kind="stable")], np.cumsum(np.bincount(text[seeds], minlength=257))[:-1])
        mark = np.zeros(n, bool)
        mark[seeds] = True
        rough = np.concatenate(_induce(text, larger, by_value, 257, budget))
        # the end comes after no suffix, so nothing has induced it
        rough = np.concatenate([np.array([n - 1], np.int32), rough[mark[rough]]])
        number = np.zeros(n, np.int32)
        number[seeds] = np.arange(len(seeds), dtype=np.int32)
        names = np.empty(len(seeds), np.int64)
        names[number[rough]] = _names(text, seeds, number, rough)
        del mark, number, rough
        # names of runs of twice as many substrings, until they reach the depth; a substring brings two bytes at least
        reach = 1
        while reach * 2 < depth + 2 and int(names.max()) + 1 < len(names):
            following = np.concatenate([names[reach:] + 1, np.zeros(min(reach, len(names)), np.int64)])
            names = np.unique(names * (len(names) + 1) + following, return_inverse=True)[1]
            reach *= 2
        seeds = seeds[np.argsort(names, kind="stable")]
    by_value = np.split(seeds[np.argsort(text[seeds], kind="stable")], np.cumsum(np.bincount(text[seeds], minlength=257))[:-1])
    order = np.concatenate(_induce(text, larger, by_value, 257, budget))
    return order[order < n - 1]


def _names(text: np.ndarray, seeds: np.ndarray, number: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Of the substrings between seeds, in order: equal numbers for equal ones."""
    ends = np.concatenate([seeds[1:], [len(text) - 1]])[number[ordered]]
    length = ends - ordered
    equal = length[1:] == length[:-1]
    left, k = np.flatnonzero(equal), 0
    while len(left):
        a, b = ordered[left], ordered[left + 1]
        on = text[a + k] == text[b + k]
        equal[left[~on]] = False
        left = left[on]
        left = left[length[left] > k]
        k += 1
    return np.concatenate([[0], np.cumsum(~equal)])


def _groups(buckets: int, of: int) -> int:
    return max(8, -(-buckets // of))


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


#: Bytes that are worked on at once where 64-bit numbers would be held for each.
CHUNK = 1 << 18


def _gathered(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some runs, one run after another."""
    upto = np.concatenate([[0], np.cumsum(size)])
    out, a = np.empty(int(upto[-1]), np.uint8), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK, "right")) - 1)
        out[upto[a] : upto[b]] = text[_places(first[a:b], size[a:b])]
        a = b
    return out


def _hashes(text: np.ndarray) -> np.ndarray:
    """The hash of the gram at each place."""
    eight = W.loads(text)
    return W.mix(W.mix(eight[: len(text) - GRAM + 1]) * np.uint64(0xA0761D6478BD642F) + eight[GRAM - 8 :])


def _least_grams(text: np.ndarray, width: int) -> np.ndarray:
    """The least hash of a gram in each window, whichever texts it lies in."""
    n = len(text) - width + 1
    out = np.empty(n, np.uint64)
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        out[a:b] = W.sliding_min(_hashes(text[a : b + width - 1]), width - GRAM + 1)
    return out


class _Windows:
    """The windows of a slice, in runs that share a document and a sampled gram."""

    def __init__(self, piece: Slice, width: int, buckets: int, narrow: bool):
        self.piece, self.width, self.buckets = piece, width, buckets
        n, at = len(piece.text), piece.at
        none = np.zeros(0, np.int64)
        self.first, self.last, self.grams, self.docs = none, none, np.zeros(0, np.uint64), none
        sizes = np.diff(at)
        if n < width or sizes.max() < width:
            return
        least = _least_grams(piece.text, width)
        new = np.concatenate([[True], least[1:] != least[:-1]])
        new[at[:-1][(at[:-1] < len(new)) & (sizes > 0)]] = True
        begins = np.flatnonzero(new)
        row = np.searchsorted(at, begins, "right") - 1
        inside = begins + width <= at[1:][row]
        heads, row = begins[inside], row[inside]
        # a run ends before the next begins, or where its document has no more windows
        until = np.concatenate([begins[1:], [n - width + 1]])[inside]
        self.first, self.last = heads, np.minimum(until, at[1:][row] - width + 1)
        # least hashes are small ones: mixed again they go to all buckets alike
        self.grams, self.docs = W.mix(least[heads]), piece.docs[row]
        if narrow:
            keys, number, several = distinct_keys(self.grams, self.docs)
            again = (several | piece.bits(0, bucket_counts(keys, _groups(buckets, KEYS_OF))))[number]
            self.first, self.last, self.grams, self.docs = self.first[again], self.last[again], self.grams[again], self.docs[again]

    def runs(self):
        """Distinct runs of bytes by gram: (first, length, smallest document), and each run's number among them."""
        size = self.last - self.first + self.width - 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        codes = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(_gathered(self.piece.text, self.first, size))]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # equal bytes have equal grams, so the order by gram keeps equal ones together
        order = np.lexsort((self.docs, codes, self.grams))
        new = np.concatenate([[True], codes[order][1:] != codes[order][:-1]]) if len(order) else np.zeros(0, bool)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        head = order[new]
        return self.first[head], size[head], self.docs[head], self.grams[head], number


def _send_grams(width: int, buckets: int):
    def run(batches):
        for piece in read_slices(batches):
            windows = _Windows(piece, width, buckets, False)
            keys = distinct_keys(windows.grams, windows.docs)[0]
            yield from sent(piece.id, bucket_counts(keys, _groups(buckets, KEYS_OF)), lambda a, b, keys=keys: keys[a:b].tobytes())

    return run


def _send_runs(width: int, buckets: int):
    def run(batches):
        compressor, groups = zstandard.ZstdCompressor(level=3), _groups(buckets, RUNS_OF)
        for piece in read_slices(batches):
            first, size, docs, grams, _ = _Windows(piece, width, buckets, True).runs()
            at = np.concatenate([[0], np.cumsum(bucket_counts(grams, groups * SHARDS))])

            def payload(a, b):
                k = int(np.searchsorted(at[::SHARDS], a, "right")) - 1
                shards = np.diff(at[k * SHARDS : (k + 1) * SHARDS + 1])
                return compressor.compress(b"".join(x.tobytes() for x in (shards, docs[a:b], grams[a:b], size[a:b], _gathered(piece.text, first[a:b], size[a:b]))))

            yield from sent(piece.id, at[SHARDS::SHARDS] - at[:-1:SHARDS], payload)

    return run


def _sort_shards(width: int, budget: int):
    def run(payloads: list[bytes]) -> list[bytes]:
        decompressor, parts = zstandard.ZstdDecompressor(), []
        for p in map(decompressor.decompress, payloads):
            shards = np.frombuffer(p, np.int64, SHARDS)
            docs, grams, sizes = (np.frombuffer(p, kind, int(shards.sum()), 8 * (SHARDS + k * int(shards.sum()))) for k, kind in enumerate((np.int64, np.uint64, np.int64)))
            parts.append((np.concatenate([[0], np.cumsum(shards)]), np.concatenate([[0], np.cumsum(sizes)]), docs, grams, sizes, np.frombuffer(p, np.uint8, -1, 8 * (SHARDS + 3 * int(shards.sum())))))
        out: list[list[np.ndarray]] = [[] for _ in parts]
        for k in range(SHARDS):
            cuts = [(at[k], at[k + 1]) for at, *_ in parts]
            docs, grams, sizes = (np.concatenate([p[c][a:b] for p, (a, b) in zip(parts, cuts)]) for c in (2, 3, 4))
            if not len(docs):
                continue
            raw = np.concatenate([p[5][p[1][a] : p[1][b]] for p, (a, b) in zip(parts, cuts)])
            windows = [int((p[4][a:b] - width + 1).sum()) for p, (a, b) in zip(parts, cuts)]
            for held, bits in zip(out, np.split(_repeats(docs, grams, sizes, raw, width, budget), np.cumsum(windows)[:-1])):
                held.append(bits)
        return [np.packbits(np.concatenate(x)).tobytes() for x in out]

    return run


def _repeats(docs: np.ndarray, grams: np.ndarray, sizes: np.ndarray, raw: np.ndarray, width: int, budget: int) -> np.ndarray:
    """Of each window of each run: whether it starts in a document with a smaller id, too."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    strings = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    number = strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    head = np.unique(number, return_index=True)[1]
    least_doc = np.full(len(head), np.iinfo(np.int64).max)
    np.minimum.at(least_doc, number, docs)
    size = sizes[head]
    text = _gathered(raw, offsets[head], size)
    # a run that shares no window has its own document's id, or that of its copy with the least
    counts = size - width + 1
    upto = np.concatenate([[0], np.cumsum(counts)])
    least = np.repeat(least_doc, counts)
    open_ = _meeting(text, size, grams[head], width)
    if open_.any():
        inside = np.repeat(open_, size)
        least[np.repeat(open_, counts)] = _least_in_order(text[inside], size[open_], least_doc[open_], width, budget)
    mine = sizes - width + 1
    return least[_places(upto[:-1][number], mine)] < np.repeat(docs, mine)


def _meeting(text: np.ndarray, size: np.ndarray, grams: np.ndarray, width: int) -> np.ndarray:
    """Which of some different runs may share a window with another one.

    Windows that are equal have their gram at one place, and beside it, on the left or on the right, the same bytes. A gram
    that is twice in a run has no one place: its runs all stay."""
    beside = min(BESIDE, (width - GRAM + 1) // 2)
    by_gram = np.unique(grams, return_inverse=True)[1]
    several = np.bincount(by_gram)[by_gram] > 1
    if not several.any():
        return several
    keep = np.flatnonzero(several)
    text, size, grams, by_gram = text[np.repeat(several, size)], size[keep], grams[keep], by_gram[keep]
    ends = np.cumsum(size)
    eight, hashed = W.loads(text), W.mix(_hashes(text))
    run_of = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(hashed == grams[run_of[: len(hashed)]])
    at = at[at + GRAM <= ends[run_of[at]]]
    times = np.bincount(run_of[at], minlength=len(size))
    unclear = np.bincount(by_gram, times != 1)[by_gram] > 0
    out = unclear.copy()
    at = at[~unclear[run_of[at]]]
    run = run_of[at]
    for begin in (at - beside, at):
        whole = (begin >= ends[run] - size[run]) & (begin + GRAM + beside <= ends[run])
        who, begin = run[whole], begin[whole]
        key = grams[who]
        for k in [*range(0, GRAM + beside - 7, 8), GRAM + beside - 8]:
            key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + eight[begin + k])
        same = np.unique(key, return_inverse=True, return_counts=True)
        out[who] |= same[2][same[1]] > 1
    several[keep] = out
    return several


def _least_in_order(raw: np.ndarray, size: np.ndarray, docs: np.ndarray, width: int, budget: int) -> np.ndarray:
    """Of each window of some runs the least document in which it starts, by the order of all suffixes."""
    # 0xFF is in no UTF-8 text: it parts the runs
    ends = np.cumsum(size + 1)
    text = np.full(int(ends[-1]), 0xFF, np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = raw
    del inside, raw
    run_of = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    starts = np.arange(len(text)) + width <= (ends - 1)[run_of]
    order = suffix_array(text, width, budget)
    order = order[starts[order]]
    eight = W.loads(np.concatenate([text, np.zeros(8, np.uint8)]))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, width - 7, 8), width - 8]:
        part = eight[order + k]
        same &= part[1:] == part[:-1]
    new = np.concatenate([[True], ~same])
    out = np.zeros(len(text), np.int64)
    out[order] = np.minimum.reduceat(docs[run_of[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out[starts]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _remove(width: int, buckets: int, with_spans: bool):
    def run(batches):
        for piece in read_slices(batches):
            windows = _Windows(piece, width, buckets, True)
            _, size, least, grams, number = windows.runs()
            counts = size - width + 1
            upto = np.concatenate([[0], np.cumsum(counts)])
            cut = np.concatenate([[0], np.cumsum(bucket_counts(grams, _groups(buckets, RUNS_OF)))])
            bits = piece.bits(1, upto[cut[1:]] - upto[cut[:-1]])
            mine = windows.last - windows.first
            place = np.repeat(windows.first - (np.cumsum(mine) - mine), mine) + np.arange(int(mine.sum()))
            bit = np.repeat(upto[:-1][number] - (np.cumsum(mine) - mine), mine) + np.arange(int(mine.sum()))
            gone = place[bits[bit] | np.repeat(windows.docs > least[number], mine)]
            hit = W.covered(len(piece.text), gone, width)
            edge = hit.copy()
            edge[1:] &= ~hit[:-1]
            heads = piece.at[:-1][piece.at[:-1] < piece.at[1:]]
            edge[heads] = hit[heads]
            upto_hit, upto_edge = np.concatenate([[0], np.cumsum(hit)]), np.concatenate([[0], np.cumsum(edge)])
            a, b = piece.at[:-1], piece.at[1:]
            removed = upto_hit[b] - upto_hit[a]
            kept, to = piece.text[~hit].tobytes(), np.concatenate([[0], np.cumsum(b - a - removed)])
            spans = None
            if with_spans:
                begin = np.flatnonzero(edge)
                stop = hit.copy()
                stop[:-1] &= ~hit[1:]
                stop[np.maximum(b[a < b] - 1, 0)] = hit[b[a < b] - 1]
                end = np.flatnonzero(stop) + 1
                per = [np.stack([begin[i:j] - x, end[i:j] - x], 1).ravel() for x, i, j in zip(a, upto_edge[a], upto_edge[b])]
                spans = pa.array(per, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.doc_ids, pa.array(b - a, pa.int64()), pa.array(removed, pa.int64()), pa.array(upto_edge[b] - upto_edge[a], pa.int64()),
                    pa.array([hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(to[:-1].tolist(), to[1:].tolist())], pa.string()), spans if with_spans else pa.nulls(len(a), pa.list_(pa.int64())),
                ],
                schema=_OUT,
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_spans: bool = True, budget: int = QUEUE_BYTES) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if asked for) spans, the removed runs as
    start, end, start, end ... in bytes. ``width`` is 24 at least."""
    with Scope(docs.sparkSession) as scope:
        table = SliceTable(docs, scope)
        buckets = table.buckets
        table.ask(0, _send_grams(width, buckets), in_several, "grams")
        table.ask(1, _send_runs(width, buckets), _sort_shards(width, budget), "shards")
        out = table.rows().mapInArrow(_remove(width, buckets, with_spans), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
        return scope.result(out, "suffix-dedup")
