"""Words, windows and hashes of whole texts, over Arrow batches with numpy.

The word classes used here separate words at ASCII characters only, so they can be told from the bytes of UTF-8."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that are in words of [^\x20\x09-\x0D]+.
PLAIN = ~SPACE
#: Bytes that are in words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of about ``limit`` bytes of text, each with its bytes and offsets."""
    text, at = utf8(batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first), text[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


class Words:
    """The words of some texts in order.

    starts, ends: byte positions of each word; rows: the text each is in; first: of each text, its first word (one more
    entry at the end); codes and distinct: dictionary encoding of the words, equal codes for equal words alone."""

    def __init__(self, text: np.ndarray, at: np.ndarray, kind: np.ndarray = PLAIN):
        inside = kind[text]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        heads = at[:-1][at[:-1] < at[1:]]
        edge[heads] = inside[heads]
        self.starts = np.flatnonzero(edge)
        edge[:] = inside
        edge[:-1] &= ~inside[1:]
        tails = at[1:][at[:-1] < at[1:]] - 1
        edge[tails] = inside[tails]
        self.ends = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.text, self._inside = text, inside

    @cached_property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @cached_property
    def _encoded(self) -> pa.DictionaryArray:
        offsets = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        return pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.text[self._inside])]).dictionary_encode()

    @cached_property
    def codes(self) -> np.ndarray:
        return self._encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @property
    def distinct(self) -> pa.Array:
        return self._encoded.dictionary

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, equal everywhere for the same bytes: eight bytes at a time."""
        eight = loads(np.concatenate([self.text, np.zeros(8, np.uint8)]))
        left = self.ends - self.starts
        out = mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64))
        at, which = self.starts, slice(None)
        while True:
            value = eight[at] & _UPTO[np.minimum(left, 8)]
            out[which] = mix(out[which] * np.uint64(0xA0761D6478BD642F) + value)
            more = left > 8
            if not more.any():
                return out
            which = np.flatnonzero(more) if isinstance(which, slice) else which[more]
            at, left = at[more] + 8, left[more] - 8

    def window_starts(self, width: int) -> np.ndarray:
        """The words at which a window of ``width`` words of one text starts."""
        if len(self) < width:
            return np.zeros(0, np.int64)
        where = np.arange(len(self) - width + 1)
        return where[self.rows[: len(where)] == self.rows[width - 1 :]]


#: Masks of the first 0 to 8 bytes of a number in memory order.
_UPTO = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def loads(text: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, as a number."""
    return np.ndarray((max(0, len(text) - 7),), "<u8", np.ascontiguousarray(text), 0, (1,)) if len(text) >= 8 else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that sums of them are good hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` values, built from runs of powers of two; order matters."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, values, 1
    left = width
    while True:
        if left & 1:
            part = power[done : done + len(values) - width + 1]
            out = mix(part) if out is None else mix(out * np.uint64(0xA0761D6478BD642F) + part)
            done += size
        left >>= 1
        if not left:
            return out
        power = mix(power[: len(power) - size] * np.uint64(0xE7037ED1A0B428DB) + power[size:])
        size *= 2


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` keys in a row."""
    if len(keys) < width:
        return np.zeros(0, keys.dtype)
    out, size = keys, 1
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    if size < width:
        out = np.minimum(out[: len(keys) - width + 1], out[width - size : width - size + len(keys) - width + 1])
    return out


def covered(length: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of ``length`` places lie in a run that begins at one of ``starts``."""
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0
