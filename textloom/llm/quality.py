"""Quality rules from compression: text that repeats itself or that doesn't compress at all is rejected.

zstandard ratios (compressed over raw bytes) of the whole text, and of chunks of fixed length, must lie in a band that
depends on the length: short texts compress worse. Null and empty texts have no words and fail the base rules; every row
gives one row, so repeated rows and equal doc_ids repeat; an empty table gives no rows. Only ``doc_id`` and ``text`` are
read, so extra columns can't clash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

LEVEL = 3
CHUNK_BYTES = 4096
#: From this many bytes on, the least and the greatest ratio of a whole text. Under the first length all is accepted.
BANDS = ((128, 0.36, 1.10), (256, 0.32, 0.86), (512, 0.28, 0.80), (1024, 0.25, 0.72), (2048, 0.23, 0.68), (4096, 0.21, 0.64), (8192, 0.19, 0.60), (16384, 0.17, 0.58))
#: The same for a chunk; a last chunk of under half the length is not judged alone.
CHUNK_BAND = (0.15, 0.70)
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_low double, chunk_high double"
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), *((c, pa.float64()) for c in ("ratio", "chunk_low", "chunk_high"))])


def per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return upto[at[1:]] - upto[at[:-1]]


def repeated_window_words(words: W.Words, width: int = WINDOW) -> np.ndarray:
    """Of each text, the words in windows of ``width`` words that occur in it more than once. Exact: windows of twice a
    length are numbered by the pair of numbers of their halves."""
    starts = words.window_starts(width)
    out = np.zeros(len(words.counts), np.int64)
    if not len(starts):
        return out
    names, size = words.codes, 1
    while size < width:
        step = min(size, width - size)
        names = np.unique(names[:-step] * (int(names.max()) + 1) + names[step:], return_inverse=True)[1]
        size += step
    keys = words.rows[starts] * (int(names.max()) + 1) + names[starts]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = W.covered(len(words), starts[twice], width)
    return np.bincount(words.rows[hit], minlength=len(out)).astype(np.int64)


def repeated_lines(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    r"""Of each text, the \n-split lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(text == 10)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]))
    row = np.searchsorted(at, starts, "right") - 1
    row[np.searchsorted(starts, at[:-1], "left")] = np.arange(len(at) - 1)
    kept = starts < len(text)
    starts, row = starts[kept], row[kept]
    ends = np.minimum(np.concatenate([starts[1:], [len(text)]]), at[row + 1])
    # the last line of a text has no \n at its end
    closed = np.where(ends > starts, text[np.maximum(ends - 1, 0)] == 10, False)
    trimmed = np.where(closed, ends - 1, ends)
    words_upto = np.concatenate([[0], np.cumsum(W.PLAIN[text], dtype=np.int64)])
    worded = words_upto[trimmed] > words_upto[starts]
    mask = np.ones(len(text), bool)
    mask[breaks] = False
    offsets = np.concatenate([[0], np.cumsum(trimmed - starts)]).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[mask])])
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(at) - 1
    keys = (row * (int(codes.max()) + 1) + codes)[worded] if len(codes) else np.zeros(0, np.int64)
    first = np.unique(keys, return_index=True)[1]
    return np.bincount(row[worded], minlength=n) - np.bincount(row[worded][first], minlength=n)


def compression(text: np.ndarray, at: np.ndarray, compressor: zstandard.ZstdCompressor) -> np.ndarray:
    """Rows of (ratio, least and greatest ratio of a chunk); chunks of texts under two chunks long are not told (nan)."""
    raw, out = text.tobytes(), np.full((len(at) - 1, 3), np.nan)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        n = b - a
        if n:
            out[k, 0] = len(compressor.compress(raw[a:b])) / n
        if n >= 2 * CHUNK_BYTES:
            chunks = [len(compressor.compress(raw[p : min(b, p + CHUNK_BYTES)])) / (min(b, p + CHUNK_BYTES) - p) for p in range(a, b - CHUNK_BYTES // 2, CHUNK_BYTES)]
            out[k, 1], out[k, 2] = min(chunks), max(chunks)
    return out


def accepted(n_bytes: np.ndarray, ratios: np.ndarray, bands=BANDS, chunk_band=CHUNK_BAND) -> np.ndarray:
    band = np.searchsorted([b[0] for b in bands], n_bytes, "right") - 1
    low, high = np.array([b[1] for b in bands])[band], np.array([b[2] for b in bands])[band]
    whole = (band < 0) | ((ratios[:, 0] >= low) & (ratios[:, 0] <= high))
    chunks = np.isnan(ratios[:, 1]) | ((ratios[:, 1] >= chunk_band[0]) & (ratios[:, 2] <= chunk_band[1]))
    return whole & chunks


def _judge(batches):
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for rows, text, at in W.slices(batch):
            words = W.Words(text, at)
            repeat = repeated_window_words(words)
            points = per_text(W.PLAIN[text] & ((text & 0xC0) != 0x80), at)
            failed = (words.counts < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * words.counts)
            ratios = compression(text, at, compressor)
            columns = (words.counts, points, per_text(_SYMBOL[text], at), repeated_lines(text, at), repeat, failed, ~failed & accepted(np.diff(at), ratios), *ratios.T)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), *(pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, list(_ARROW)[1:]))], schema=_ARROW)


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: base counts, verdicts and ratios. No shuffle; each text is read once."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_judge, SCHEMA)


def _filter(batches):
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for rows, text, at in W.slices(batch):
            words = W.Words(text, at)
            repeat = repeated_window_words(words)
            good = (words.counts >= MIN_WORDS) & (100 * repeat <= REPEAT_PERCENT * words.counts) & accepted(np.diff(at), compression(text, at, compressor))
            yield rows.filter(pa.array(good))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are accepted, with all their columns; the text column is ``text``."""
    return docs.mapInArrow(_filter, docs.schema)
