"""Repeated passages of words, by doubling the length of the windows that are compared.

Windows of about a quarter of the length are compared over the whole corpus first, a sample of them that no longer window
can miss: of every run of places at which a short window fits into a long one, the place with the least hash. Long
windows whose short one is found alone are out. What is left is compared at twice the length, and at last at the full
length; there every window that is left is compared, by a 96-bit hash.

A word goes if a window that covers it, word for word, also starts in a document with a smaller doc_id. Null and empty
texts have no words. Rows with one doc_id are one document: they take nothing from each other. Each row gives one row; an
empty table gives none. A null doc_id comes last."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .shared import Scope
from .slices import Slice, SliceTable, bucket_counts, distinct_keys, in_several, read_slices, sent

WIDTH = 50


def levels(width: int) -> list[int]:
    """The lengths before the full one, each twice the one before (rounded up)."""
    return [-(-width // 4), -(-width // 2)] if width >= 8 else []


class _Windows:
    """The windows of a slice that are still candidates."""

    def __init__(self, piece: Slice, width: int, buckets: int):
        self.piece, self.width, self.buckets = piece, width, buckets
        self.words = W.Words(piece.text, piece.at)
        self.hashes = self.words.hashes()
        self.starts = self.words.window_starts(width)

    def docs(self) -> np.ndarray:
        return self.piece.docs[self.words.rows[self.starts]]

    def level_keys(self, size: int) -> np.ndarray:
        """For each candidate, the hash of the sampled window of ``size`` words in it."""
        return W.sliding_min(W.rolled(self.hashes, size), self.width - size + 1)[self.starts]

    def narrow(self, upto: int) -> None:
        """Leave the candidates that the answers of the first ``upto`` levels found repeated."""
        for level, size in enumerate(levels(self.width)[:upto]):
            keys, number, several = distinct_keys(self.level_keys(size), self.docs())
            again = several | self.piece.bits(level, bucket_counts(keys, self.buckets))
            self.starts = self.starts[again[number]]

    def full(self):
        """The last level: distinct 96-bit keys in order, each with its smallest document here."""
        one = W.rolled(self.hashes, self.width)[self.starts]
        other = (W.rolled(self.words.hashes(1), self.width)[self.starts] >> np.uint64(32)).astype(np.uint32)
        docs = self.docs()
        order = np.lexsort((docs, other, one))
        one, other, docs = one[order], other[order], docs[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (other[1:] != other[:-1])]) if len(one) else np.zeros(0, bool)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return one[new], other[new], docs[new], number


def pack_keys(one: np.ndarray, other: np.ndarray, docs: np.ndarray) -> bytes:
    return np.array([len(one)], np.int64).tobytes() + one.tobytes() + other.tobytes() + docs.tobytes()


def in_smaller(payloads: list[bytes]) -> list[bytes]:
    """For slices' keys with their smallest document: which are in a smaller document of another slice."""
    one, other, docs, sizes = [], [], [], []
    for p in payloads:
        n = int(np.frombuffer(p, np.int64, 1)[0])
        sizes.append(n)
        one.append(np.frombuffer(p, np.uint64, n, 8))
        other.append(np.frombuffer(p, np.uint32, n, 8 + 8 * n))
        docs.append(np.frombuffer(p, np.int64, n, 8 + 12 * n))
    one, other, docs = np.concatenate(one), np.concatenate(other), np.concatenate(docs)
    order = np.lexsort((docs, other, one))
    one, other = one[order], other[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (other[1:] != other[:-1])])
    least = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    smaller = np.empty(len(docs), bool)
    smaller[order] = least < docs[order]
    return [np.packbits(x).tobytes() for x in np.split(smaller, np.cumsum(sizes)[:-1])]


def _send_level(level: int, width: int, buckets: int):
    def run(batches):
        for piece in read_slices(batches):
            windows = _Windows(piece, width, buckets)
            windows.narrow(level)
            keys = distinct_keys(windows.level_keys(levels(width)[level]), windows.docs())[0]
            yield from sent(piece.id, bucket_counts(keys, buckets), lambda a, b, keys=keys: keys[a:b].tobytes())

    return run


def _send_full(width: int, buckets: int):
    def run(batches):
        for piece in read_slices(batches):
            windows = _Windows(piece, width, buckets)
            windows.narrow(len(levels(width)))
            one, other, docs, _ = windows.full()
            yield from sent(piece.id, bucket_counts(one, buckets), lambda a, b, k=(one, other, docs): pack_keys(*(x[a:b] for x in k)))

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _remove(width: int, buckets: int, with_text: bool):
    def run(batches):
        for piece in read_slices(batches):
            windows = _Windows(piece, width, buckets)
            windows.narrow(len(levels(width)))
            one, _, least, number = windows.full()
            smaller = piece.bits(len(levels(width)), bucket_counts(one, buckets))
            gone = smaller[number] | (windows.docs() > least[number])
            words = windows.words
            kept = ~W.covered(len(words), windows.starts[gone], width)
            size = np.where(kept, words.ends - words.starts + 1, 0)
            ends = np.cumsum(size)
            place = np.repeat(words.starts - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            joined = piece.text[np.minimum(place, max(len(piece.text) - 1, 0))].copy()
            joined[ends[kept] - 1] = 0x20
            upto = np.concatenate([[0], ends])
            raw, texts, n_kept = joined.tobytes(), [], np.concatenate([[0], np.cumsum(kept)])
            for a, b in zip(upto[words.first[:-1]].tolist(), upto[words.first[1:]].tolist()):
                texts.append(raw[a : max(a, b - 1)])
            removed = words.counts - (n_kept[words.first[1:]] - n_kept[words.first[:-1]])
            yield pa.RecordBatch.from_arrays(
                [piece.doc_ids, pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode() for t in texts] if with_text else [None] * len(texts), pa.string())],
                schema=_OUT,
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and (if asked for) kept_text."""
    with Scope(docs.sparkSession) as scope:
        table = SliceTable(docs, scope)
        buckets = table.buckets
        for level, _ in enumerate(levels(width)):
            table.ask(level, _send_level(level, width, buckets), in_several, f"level{level}")
        table.ask(len(levels(width)), _send_full(width, buckets), in_smaller, "full")
        out = table.rows().mapInArrow(_remove(width, buckets, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
        return scope.result(out, "level-doubling")
