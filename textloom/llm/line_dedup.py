r"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line kept per group.

A line (between \n) is normalised: A-Z to lower case, and every run of ASCII characters other than letters and digits to one
space. Lines without a word are always kept. Equal normalised lines are one group from the start. Two others are linked if
their Levenshtein distance is at most ``EDIT_PERCENT`` percent of the longer one, so lines under ten characters have equal
ones alone. Of each connected group the occurrence with the least (doc_id, line) stays; the others go.

The pigeonhole blocks are those of the line, not of the SimHash's bits: an edit of a tenth of a line moves ten or more of
64 bits, and no few blocks of bits are left whole by that. What a few edits can't touch are most runs of words. A line of up
to ``SHORT`` words is filed under itself and under itself without each one of its words, so a changed, added or missing
word leaves a common block; a longer line is filed under ``SAMPLED`` runs of ``RUN`` words, those with the least hashes,
which a line of nearly the same words samples as well. Lines that meet in a block are compared by SimHash: if it differs
in few enough bits, and what stands before and after the block by a tenth of the line together, they are a candidate pair,
whose texts are moved and verified.

A search over slices tells first which lines have such a partner anywhere, so the texts of all others are never moved. In a
block of up to ``SMALL`` lines all candidate pairs are verified, each once however many blocks it shares; a larger one
proposes a star first, and whatever is still apart in it is compared part by part, verified on the spot and without a row for
a pair, so no candidate is lost.

Null texts stay null and empty ones empty; rows with one doc_id are one document; a null doc_id comes last. Every row gives
one row, with its columns as they are, and an empty table gives none."""

from __future__ import annotations

import bisect
import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import words as W
from .shared import Scope
from .slices import SliceTable, bucket_counts, read_slices, sent

EDIT_PERCENT = 10
#: Bits of the SimHashes that a candidate pair may differ in, by the longer one's characters: one changed word of four moves
#: 15 bits, one of ten 9. Two lines without a common word differ in 32.
DISTANCE = ((0, 24), (64, 16), (200, 14))
#: Lines of up to this many words are filed under themselves without a word; from this many characters on any edit is allowed.
SHORT, FUZZY_CHARS = 7, 10
RUN, SAMPLED = 4, 8
SMALL = 16
#: Lines of a large block that one task holds at once.
PART = 2048
#: Lines of a block that each line is compared with when partners are told; a block with more goes on whole.
LOOKED_AT = 1024

#: Each bit of a byte in a byte of its own, so that eight counters are added at once.
_SPREAD = np.array([sum(1 << (8 * k) for k in range(8) if b >> k & 1) for b in range(256)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def simhashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bitwise majority of each line's word hashes; counts: words of each line, none 0."""
    # counters have eight bits, so a line is added up in runs of 255 words
    runs = -(-counts // 255)
    line = np.repeat(np.arange(len(counts)), runs)
    first_run = np.cumsum(runs) - runs
    begins = np.repeat(np.cumsum(counts) - counts, runs) + 255 * (np.arange(len(line)) - np.repeat(first_run, runs))
    ones = np.empty((len(line), 8), np.uint64)
    parts = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        ones[:, k] = np.add.reduceat(_SPREAD[parts[:, k]], begins)
    ones = np.add.reduceat(ones.view(np.uint8).reshape(len(line), 64), first_run, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _runs_of(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def line_starts(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the lines of some texts begin; a line's number is its place among these."""
    return np.union1d(at[:-1][np.diff(at) > 0], np.flatnonzero(text == 10) + 1)


def line_places(numbers: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some lines with a word, by number: the text each is in, and which line of it it is."""
    rows = np.searchsorted(at, starts[numbers], "right") - 1
    return rows, numbers - np.searchsorted(starts, at[rows])


class Lines:
    """The lines of a slice that have a word: of each occurrence its number and a code of its normalised text; of each code
    its key and its first occurrence (``head``), by document and line."""

    def __init__(self, text: np.ndarray, at: np.ndarray, docs: np.ndarray):
        text = W.LOWER[text]
        self.words = words = W.Words(text, at, W.ALNUM)
        starts = line_starts(text, at)
        begins = np.searchsorted(words.starts, np.concatenate([starts, [len(text)]]))
        self.numbers = np.flatnonzero(np.diff(begins))
        first, counts = begins[self.numbers], np.diff(begins)[self.numbers]
        self.hashes = words.hashes()
        place = (np.arange(len(self.hashes)) - np.repeat(first, counts)).astype(np.uint64)
        whole = np.add.reduceat(W.mix(self.hashes + place * _STEP), first) if len(first) else np.zeros(0, np.uint64)
        self.keys, self.codes = np.unique(W.mix(whole + counts.astype(np.uint64)), return_inverse=True)
        rows, line = line_places(self.numbers, starts, at)
        order = np.lexsort((line, docs[rows], self.codes))
        self.head = order[np.searchsorted(self.codes[order], np.arange(len(self.keys)))]
        self.first, self.counts = first[self.head], counts[self.head]

    @cached_property
    def _upto(self) -> np.ndarray:
        """Characters of the words before each word."""
        words = self.words
        size = words.ends - words.starts
        # bytes that go on with a character are always in words
        inner = np.flatnonzero((words.text & 0xC0) == 0x80)
        if len(inner):
            size = size - np.bincount(np.searchsorted(words.starts, inner, "right") - 1, minlength=len(size))
        return np.concatenate([[0], np.cumsum(size)])

    def sizes(self) -> np.ndarray:
        """Characters of each distinct line, with a space between words."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        of = self._upto
        return of[self.first + self.counts] - of[self.first] + self.counts - 1

    def blocks(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, block, place): what each distinct line is filed under, each block once, and the characters before it."""
        short = self.counts <= SHORT
        code, block, place = [np.flatnonzero(short)], [self.keys[short]], [np.zeros(int(short.sum()), np.int64)]
        for n in range(2, SHORT + 1):
            mine = np.flatnonzero((self.counts == n) & (sizes >= FUZZY_CHARS))
            if len(mine):
                words = self.hashes[self.first[mine][:, None] + np.arange(n)]
                order = np.arange(n, dtype=np.uint64) * _STEP
                # a word after the missing one stands a place earlier
                before, after = W.mix(words + order), W.mix(words + (order - _STEP))
                for k in range(n):
                    code.append(mine)
                    block.append(W.mix(before[:, :k].sum(axis=1) + after[:, k + 1 :].sum(axis=1) + np.uint64(n - 1)))
                    place.append(np.zeros(len(mine), np.int64))
        # a line may lose either of two equal words in a row
        parts = [np.concatenate(x) for x in (code, block, place)]
        order = np.lexsort((parts[0], parts[1]))
        parts = [x[order] for x in parts]
        new = np.concatenate([[True], (parts[0][1:] != parts[0][:-1]) | (parts[1][1:] != parts[1][:-1])]) if len(order) else np.zeros(0, bool)
        code, block, place = ([x[new]] for x in parts)
        long = np.flatnonzero(~short)
        if len(long):
            n = self.counts[long] - RUN + 1
            at = _runs_of(self.first[long], n)
            hashed = W.rolled(self.hashes, RUN)[at]
            # the sample is among the few least; what is far above them needs no sorting
            most = np.uint64(2**64 - 1)
            few = hashed <= np.repeat(np.where(n > 3 * SAMPLED, most // n.astype(np.uint64) * np.uint64(3 * SAMPLED), most), n)
            # a line that says the same again and again has too few different runs for that
            few |= np.repeat(np.add.reduceat(few, np.cumsum(n) - n, dtype=np.int64) < SAMPLED, n)
            owner, hashed, at = np.repeat(np.arange(len(long)), n)[few], hashed[few], at[few]
            # one number to sort by: the line, then its run's hash as far as there is room
            bits = max(1, len(long).bit_length())
            by = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (hashed >> np.uint64(bits))
            order = np.argsort(by)
            by = by[order]
            new = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
            at = np.minimum.reduceat(at[order], new)
            owner, hashed = long[owner[order[new]]], hashed[order[new]]
            sampled = np.arange(len(owner)) - np.searchsorted(owner, owner) < SAMPLED
            owner, hashed, at = owner[sampled], hashed[sampled], at[sampled]
            code.append(owner)
            block.append(hashed)
            of = self._upto
            place.append(of[at] - of[self.first[owner]] + at - self.first[owner])
        code, block, place = np.concatenate(code), np.concatenate(block), np.concatenate(place)
        order = np.argsort(block)
        return code[order], block[order], place[order]

    def simhashes(self) -> np.ndarray:
        return simhashes(self.hashes[_runs_of(self.first, self.counts)], self.counts) if len(self.keys) else np.zeros(0, np.uint64)

    def texts(self, codes: np.ndarray) -> list[str]:
        """The normalised texts of some codes."""
        first, n = self.first[codes], self.counts[codes]
        which = _runs_of(first, n)
        begin, size = self.words.starts[which], self.words.ends[which] - self.words.starts[which] + 1
        place = _runs_of(begin, size)
        raw = self.words.text[np.minimum(place, len(self.words.text) - 1)].copy() if len(place) else np.zeros(0, np.uint8)
        upto = np.cumsum(size)
        raw[upto - 1] = 0x20
        last = np.concatenate([[0], upto])[np.cumsum(n)] if len(n) else np.zeros(0, np.int64)
        raw, begin, out = raw.tobytes(), 0, []
        for end in last.tolist():
            out.append(raw[begin : end - 1].decode())
            begin = end
        return out


#: What a slice files under a block: the SimHash, 32 bits of the line's key, its size, the characters before the block, and
#: the line's number in the slice.
_ENTRY = np.dtype([("block", "<u8"), ("simhash", "<u8"), ("line", "<u4"), ("size", "<u4"), ("place", "<u4"), ("number", "<u4")])
#: What is answered of an entry with a partner.
_NEAR = np.dtype([("block", "<u8"), ("place", "<u4"), ("number", "<u4")])
#: An occurrence of a line that is in the slice before, and the number that stands for the line.
_AGAIN = np.dtype([("number", "<u4"), ("of", "<u4")])


def _entries(lines: Lines) -> np.ndarray:
    """The entries in order of block."""
    sizes = lines.sizes()
    code, block, place = lines.blocks(sizes)
    out = np.empty(len(code), _ENTRY)
    out["block"], out["simhash"], out["line"], out["size"] = block, lines.simhashes()[code], (lines.keys[code] >> np.uint64(32)).astype(np.uint32), sizes[code]
    out["place"], out["number"] = place, lines.numbers[lines.head][code]
    return out


def _again(lines: Lines) -> np.ndarray:
    stands = lines.head[lines.codes]
    other = np.flatnonzero(stands != np.arange(len(stands)))
    out = np.empty(len(other), _AGAIN)
    out["number"], out["of"] = lines.numbers[other], lines.numbers[stands[other]]
    return out


def _packed(*parts: np.ndarray) -> bytes:
    return b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *(p.tobytes() for p in parts)])


def _unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, np.frombuffer(data, np.int64, len(kinds)).tolist()):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def candidates(one, other, size_one, size_other, place_one, place_other) -> np.ndarray:
    """Whether lines that meet in a block may be within the edit distance, by their SimHashes, sizes and the block's places."""
    longer = np.maximum(size_one, size_other)
    bits = np.array([b for _, b in DISTANCE])[np.searchsorted([n for n, _ in DISTANCE], longer, "right") - 1]
    moved = np.abs(place_one - place_other)
    moved = moved + np.abs(size_one - size_other - (place_one - place_other))
    return (np.bitwise_count((one ^ other).view(np.uint64)) <= bits) & (100 * moved <= EDIT_PERCENT * longer)


def _send(buckets: int):
    """To each bucket a slice's entries; one of them also gets, and gives back, what is told of the slice by itself."""

    def run(batches):
        for piece in read_slices(batches):
            lines = Lines(piece.text, piece.at, piece.docs)
            entries, again = _entries(lines), _again(lines)
            counts = bucket_counts(entries["block"], buckets)
            if len(entries):
                held = np.flatnonzero(counts)
                own = int(held[int(W.mix(np.array([piece.id], np.uint64))[0]) % len(held)])
                upto = int(counts[:own].sum())
                yield from sent(piece.id, counts, lambda a, b: _packed(again if a == upto else again[:0], entries[a:b]))

    return run


def partners(payloads: list[bytes]) -> list[bytes]:
    """Of each slice's entries, those with which another line of their block is a candidate, and the numbers of the lines
    that are in another slice too."""
    agains, parts = zip(*(_unpacked(p, _AGAIN, _ENTRY) for p in payloads))
    entries = np.concatenate(parts)
    block = entries["block"]
    order = np.argsort(block)
    block = block[order]
    # most blocks have one line
    met = np.zeros(len(order) + 1, bool)
    met[1:-1] = block[1:] == block[:-1]
    order = order[met[1:] | met[:-1]]
    some = entries[order]
    order = order[np.lexsort((some["line"], some["size"], some["block"]))]
    block, simhash, line, size, place = (entries[c][order] for c in ("block", "simhash", "line", "size", "place"))
    size, place = size.astype(np.int64), place.astype(np.int64)
    near, same = np.zeros(len(order), bool), np.zeros(len(order), bool)
    left, step = np.arange(len(order)), 1
    while len(left):
        left = left[left + step < len(order)]
        other = left + step
        # sizes grow within a block: beyond a tenth there is nothing more to meet
        going = (block[left] == block[other]) & (100 * (size[other] - size[left]) <= EDIT_PERCENT * size[other])
        left, other = left[going], other[going]
        if step == LOOKED_AT:
            near |= np.isin(block, np.unique(block[left]))
            break
        equal = (line[left] == line[other]) & (simhash[left] == simhash[other]) & (size[left] == size[other])
        hit = ~equal & candidates(simhash[left], simhash[other], size[left], size[other], place[left], place[other])
        for flag, which in ((near, hit), (same, equal)):
            flag[left[which]] = flag[other[which]] = True
        step += 1
    flags = np.zeros((len(entries), 2), bool)
    flags[order, 0], flags[order, 1] = near, same
    out, first = [], 0
    for again, part in zip(agains, parts):
        (near, same), first = flags[first : first + len(part)].T, first + len(part)
        told = np.empty(int(near.sum()), _NEAR)
        for c in _NEAR.names:
            told[c] = part[c][near]
        out.append(_packed(again, told, np.unique(part["number"][same])))
    return out


_MEETING = pa.schema([("slice_id", pa.int64()), ("id", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int64()), ("numbers", pa.list_(pa.int64())), ("simhash", pa.int64()), ("size", pa.int64()), ("blocks", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("plain", pa.string())])
_MEETING_SQL = "slice_id long, id long, doc_id long, line long, numbers array<long>, simhash long, size long, blocks array<long>, places array<long>, plain string"


def _lists(owner: np.ndarray, of: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The columns as lists, one for each of ``of``."""
    order = np.argsort(owner, kind="stable")
    offsets = pa.array(np.concatenate([np.searchsorted(owner[order], of), [len(owner)]]), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int64())) for x in columns]


def _meeting(batches):
    """The distinct lines of each slice that occur again or have a partner, with their first occurrence in it and all their
    numbers; those with a partner with the blocks in which it is and their texts."""
    for piece in read_slices(batches):
        replies = [_unpacked(r, _AGAIN, _NEAR, "<u4") for r in piece.answers(0)]
        if not replies:
            continue
        again, near, same = (np.concatenate(x) for x in zip(*replies))
        number = np.unique(np.concatenate([again["of"], near["number"], same])).astype(np.int64)
        # nothing but these lines is worked out again, each as a text of its own
        starts = line_starts(piece.text, piece.at)
        begin = starts[number]
        size = np.concatenate([starts, [len(piece.text)]])[number + 1] - begin
        rows, line = line_places(number, starts, piece.at)
        lines = Lines(piece.text[_runs_of(begin, size)], np.concatenate([[0], np.cumsum(size)]), piece.docs[rows])
        code, is_near = lines.codes, np.isin(number, near["number"])
        texts = np.full(len(number), None, object)
        texts[is_near] = lines.texts(code[is_near])
        (numbers,) = _lists(np.concatenate([number, again["of"]]), number, np.concatenate([number, again["number"]]))
        blocks, places = _lists(near["number"], number, near["block"].view(np.int64), near["place"])
        columns = (np.full(len(number), piece.id), lines.keys[code].view(np.int64), piece.docs[rows], line, numbers, lines.simhashes()[code].view(np.int64), lines.sizes()[code], blocks, places)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, _MEETING)), pa.array(texts, pa.string())], schema=_MEETING)


def _sided(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{side}") for c in columns))


def _fits(a: str, b: str) -> Column:
    """``candidates`` as an expression."""
    bits = F.bit_count(F.col(f"simhash_{a}").bitwiseXOR(F.col(f"simhash_{b}")))
    one, other = F.col(f"size_{a}"), F.col(f"size_{b}")
    longer, shift = F.greatest(one, other), F.col(f"place_{a}") - F.col(f"place_{b}")
    most = F.lit(DISTANCE[0][1])
    for size, distance in DISTANCE[1:]:
        most = F.when(longer >= size, distance).otherwise(most)
    return (bits <= most) & (100 * (F.abs(shift) + F.abs(one - other - shift)) <= EDIT_PERCENT * longer)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) within the edit distance."""
    met = pairs.join(texts.select(F.col("id").alias("a"), F.col("plain").alias("one")), "a").join(texts.select(F.col("id").alias("b"), F.col("plain").alias("other")), "b")
    return met.select("a", "b", "one", "other").mapInArrow(_verify, "a long, b long")


def _verify(batches):
    for batch in batches:
        good = pa.array(all_within(batch.column(2).to_pylist(), batch.column(3).to_pylist()), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in range(2)], names=["a", "b"])


def profile(text: str) -> np.ndarray:
    """How often each pair of neighbouring characters occurs, in 256 classes. An edit moves at most four of the counts by
    one, so a quarter of two profiles' differences is never above the edit distance."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.minimum(np.bincount((points[:-1] * 31 + points[1:]) & 255, minlength=256), 32767).astype(np.int16)


#: Characters after which it is looked whether the limit can still be kept.
LOOK = 128


def edits(one: str, other: str, limit: int | None = None) -> int:
    """The Levenshtein distance, by the bit-parallel table of Myers (1999); more than the limit is limit + 1."""
    if len(one) > len(other):
        one, other = other, one
    if not one:
        return len(other)
    n, every, top = len(one), (1 << len(one)) - 1, 1 << (len(one) - 1)
    where: dict[str, int] = {}
    for k, c in enumerate(one):
        where[c] = where.get(c, 0) | 1 << k
    up, down, distance = every, 0, n
    for done, c in enumerate(other, 1):
        equal = where.get(c, 0)
        vertical = equal | down
        level = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (every & ~(level | up)), up & level
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(vertical | plus)) & every, plus & vertical & every
        if limit is not None and done % LOOK == 0:
            # the column's distances, and at least what then stands over at the end
            bits = [np.unpackbits(np.frombuffer(x.to_bytes(-(-n // 8), "little"), np.uint8), count=n, bitorder="little").astype(np.int32) for x in (up, down)]
            column = done + np.concatenate([[0], np.cumsum(bits[0] - bits[1])])
            if (column + np.abs((n - np.arange(n + 1)) - (len(other) - done))).min() > limit:
                return limit + 1
    return distance


def aligned(a: list[str], b: list[str], limit: int) -> int:
    """The edits of one way from words to words, which may not be the shortest: where they part, the nearest two words in
    a row that are common again are kept. Stops beyond the limit."""
    i = j = spent = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for skip in range(1, 9):
            near = [(x, skip - x) for x in range(skip + 1) if a[i + x : i + x + 2] == b[j + skip - x : j + skip - x + 2] and i + x < len(a)]
            if near:
                break
        else:
            return limit + 1
        x, y = min(near, key=lambda n: abs(n[0] - n[1]))
        spent += edits("".join(w + " " for w in a[i : i + x]), "".join(w + " " for w in b[j : j + y]))
        if spent > limit:
            return spent
        i, j = i + x, j + y
    return spent + edits(" ".join(a[i:]), " ".join(b[j:])) + (bool(a[i:]) != bool(b[j:]))


def within(one: str, other: str) -> bool:
    """Whether two texts are within the edit distance; what is quickly told is told first."""
    limit = EDIT_PERCENT * max(len(one), len(other)) // 100
    if abs(len(one) - len(other)) > limit:
        return False
    a, b = one.split(" "), other.split(" ")
    # word for word is one way to edit: if that is within the limit, the shortest is
    if len(a) == len(b) and sum(max(len(x), len(y)) for x, y in zip(a, b) if x != y) <= limit:
        return True
    if int(np.abs(profile(one) - profile(other)).sum(dtype=np.int64)) > 4 * limit:
        return False
    if (sum(edits(x, y) for x, y in zip(a, b) if x != y) if len(a) == len(b) else aligned(a, b, limit)) <= limit:
        return True
    # what begins and ends alike needs no edit
    most, k, n = min(len(a), len(b)), 0, 0
    while k < most and a[k] == b[k]:
        k += 1
    while n < most - k and a[-1 - n] == b[-1 - n]:
        n += 1
    return edits(" ".join(a[k : len(a) - n]), " ".join(b[k : len(b) - n]), limit) <= limit


#: Pairs of which a table of distances is filled in at once, the fewest for which that pays, and the characters of a line
#: from which on one pair is told alone (limits stay in a byte).
ABREAST, FEW, ALONE = 256, 6, 2500
#: Steps of that table after which it is looked which pairs can still keep their limits.
LOOK_ABREAST = 64


def _laid(texts: list[str], sizes: np.ndarray, before: int, length: int, filler: int) -> np.ndarray:
    """The characters of texts, a column each, with a filler around them."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) + np.uint32(2)
    out = np.full((length, len(texts)), filler, np.uint16 if points.max(initial=0) < 1 << 16 else np.uint32)
    out[_runs_of(np.full(len(texts), before), sizes), np.repeat(np.arange(len(texts)), sizes)] = points
    return out


def _banded(ones: list[str], others: list[str], limits: np.ndarray) -> np.ndarray:
    """Whether each two texts are within their limit: Levenshtein's table for all pairs together, one diagonal across the
    matches after another, only as far from the main diagonal as the largest limit. Texts are shorter than ``ALONE``.

    Distances never shrink on the way, and from a diagonal to that of the end it takes an edit a step: pairs that can't
    keep their limit any more are left out of the rest."""
    sizes, other_sizes = (np.array([len(x) for x in texts]) for texts in (ones, others))
    far, cap = int(limits.max()) + 1 & ~1, np.uint8(253)
    ends = sizes + other_sizes
    last = int(ends.max())
    # (i, j) with i + j = step and i - j up to ``far``: both stay within these rows
    length = last // 2 + far + 2
    a, b = _laid(ones, sizes, far, length + far, 0), _laid(others, other_sizes, far, length + far, 1)[::-1].copy()
    # steps off the main diagonal, even and odd ones; each looks at the other kind's last and its own last but one
    even, odd = np.full((far + 1, len(ones)), cap), np.full((far + 2, len(ones)), cap)
    even[far // 2] = 0
    beside, differs = np.empty((far + 1, len(ones)), np.uint8), np.empty((far + 1, len(ones)), bool)
    off, off_even, off_odd = (x.astype(np.int16) for x in (sizes - other_sizes, np.arange(-far, far + 1, 2)[:, None], np.arange(1 - far, far, 2)[:, None]))
    out, which = np.zeros(len(ones), bool), np.arange(len(ones))
    order = np.argsort(ends, kind="stable")
    upto = np.searchsorted(ends[order], np.arange(last + 2))
    out[order[: upto[1]]] = True
    step = 0
    while step < last:
        step += 1
        mine, other, low = (even, odd, -far) if step % 2 == 0 else (odd[1:-1], even, 1 - far)
        n, at, back = len(mine), (step + low) // 2 - 1 + far, len(b) - 1 - ((step - low) // 2 - 1 + far)
        np.not_equal(a[at : at + n], b[back : back + n], out=differs[:n])
        np.minimum(other[:-1], other[1:], out=beside[:n])
        np.minimum(beside[:n], cap, out=beside[:n])
        beside[:n] += 1
        mine += differs[:n].view(np.uint8)
        np.minimum(mine, beside[:n], out=mine)
        done = order[upto[step] : upto[step + 1]]
        if len(done):
            done = done[np.abs(off[done]) <= far]
            out[which[done]] = (even[(off[done] + far) // 2, done] if step % 2 == 0 else odd[(off[done] + far + 1) // 2, done]) <= limits[done]
        if step % LOOK_ABREAST == 0:
            # a way to the end passes this diagonal across the matches or the last one
            least = np.minimum((even + np.abs(off_even - off)).min(axis=0), (odd[1:-1] + np.abs(off_odd - off)).min(axis=0))
            open_ = np.flatnonzero((least <= limits) & (ends > step))
            if not len(open_):
                break
            if 4 * len(open_) <= 3 * len(which):
                which, off, ends, limits = which[open_], off[open_], ends[open_], limits[open_]
                a, b, even, odd = (np.ascontiguousarray(x[:, open_]) for x in (a, b, even, odd))
                beside, differs = np.empty(even.shape, np.uint8), np.empty(even.shape, bool)
                order, last = np.argsort(ends, kind="stable"), int(ends.max())
                upto = np.searchsorted(ends[order], np.arange(last + 2))
    return out


def all_within(ones: list[str], others: list[str]) -> np.ndarray:
    """``within`` for pairs of texts; those that aren't quickly told are told together, lines of about a length at a time."""
    out, open_ = np.zeros(len(ones), bool), []
    for k, (one, other) in enumerate(zip(ones, others)):
        longer = max(len(one), len(other))
        limit = EDIT_PERCENT * longer // 100
        if abs(len(one) - len(other)) > limit:
            continue
        if longer >= ALONE:
            out[k] = within(one, other)
            continue
        a, b = one.split(" "), other.split(" ")
        if len(a) == len(b) and sum(max(len(x), len(y)) for x, y in zip(a, b) if x != y) <= limit:
            out[k] = True
        else:
            open_.append((longer, k, limit))
    open_.sort()
    first = 0
    while first < len(open_):
        # one table is as large as its longest pair asks for
        like = bisect.bisect_right(open_, open_[first][0] * 5 // 4, first, min(first + ABREAST, len(open_)), key=lambda p: p[0])
        some, first = open_[first:like], like
        which = [k for _, k, _ in some]
        if len(some) < FEW:
            out[which] = [within(ones[k], others[k]) for k in which]
            continue
        out[which] = _banded([ones[k] for k in which], [others[k] for k in which], np.array([limit for *_, limit in some]))
    return out


class _Part:
    """Lines of a large block that others are compared with; what is found joined stays joined."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.joined: dict[int, int] = {}
        self.profiles = None

    def label(self, label: int) -> int:
        while (up := self.joined.get(label, label)) != label:
            label = up
        return label

    def close(self) -> None:
        self.id, self.labels, self.simhash, self.size, self.place = (np.array([r[k] for r in self.rows], np.int64) for k in range(5))
        self.blocks = np.zeros((len(self.rows), max(len(r[6]) for r in self.rows), 2), np.int64)
        for k, r in enumerate(self.rows):
            self.blocks[k, : len(r[6])] = [(b["block"], b["place"]) for b in r[6]]

    def opened(self, block: int, rows: list[tuple]) -> list[tuple[tuple, list[int]]]:
        """Other lines of the block with the lines of this part that each is to be compared with, the nearest first."""
        label, simhash, size, place = (np.array([r[k] for r in rows], np.int64)[:, None] for k in range(1, 5))
        fits = candidates(simhash, self.simhash, size, self.size, place, self.place) & (label != self.labels)
        found = ((rows[k], self._open(block, rows[k], np.flatnonzero(fits[k]))) for k in np.flatnonzero(fits.any(axis=1)).tolist())
        return [(row, fits) for row, fits in found if fits]

    def apart(self, row: tuple, fits: list[int], most: int) -> tuple[list[int], list[int]]:
        """The first ``most`` lines that a line isn't joined with by now, and what comes after them."""
        own, out = self.label(row[1]), []
        for n, k in enumerate(fits, 1):
            if self.label(self.rows[k][1]) != own:
                out.append(k)
                if len(out) == most:
                    return out, fits[n:]
        return out, []

    def _open(self, block: int, row: tuple, fits: np.ndarray) -> list[int]:
        node, label, simhash, size, place, plain, blocks = row
        # a pair is compared in the least of the blocks in which it is a candidate
        before = np.array([(b["block"], b["place"]) for b in blocks if b["block"] < block], np.int64).reshape(-1, 2)
        if len(before):
            theirs = self.blocks[fits][:, :, None]
            shift = before[:, 1] - theirs[..., 1]
            moved = np.abs(shift) + np.abs(size - self.size[fits][:, None, None] - shift)
            met = (theirs[..., 0] == before[:, 0]) & (100 * moved <= EDIT_PERCENT * np.maximum(size, self.size[fits])[:, None, None])
            fits = fits[~met.any(axis=(1, 2))]
        if not len(fits):
            return []
        if self.profiles is None:
            self.profiles = np.stack([profile(r[5]) for r in self.rows])
        limit = EDIT_PERCENT * np.maximum(size, self.size[fits]) // 100
        fits = fits[np.abs(self.profiles[fits] - profile(plain)).sum(axis=1, dtype=np.int32) <= 4 * limit]
        return fits[np.argsort(np.bitwise_count((self.simhash[fits] ^ np.int64(simhash)).view(np.uint64)), kind="stable")].tolist()


def _linked(waiting: list[tuple[_Part, tuple, list[int]]]) -> pa.RecordBatch:
    """Links of lines (with the part they are held against and its lines in question), compared all together. The nearest
    come first: they most likely join the two, and then the rest of that group needs no look."""
    links, many = [], 2
    while waiting:
        now, later = [], []
        for part, row, fits in waiting:
            first, rest = part.apart(row, fits, many)
            now.extend((part, row, part.rows[k]) for k in first)
            if rest:
                later.append((part, row, rest))
        good = all_within([row[5] for _, row, _ in now], [other[5] for *_, other in now])
        for k in np.flatnonzero(good).tolist():
            part, row, other = now[k]
            one, two = part.label(row[1]), part.label(other[1])
            if one != two:
                part.joined[max(one, two)] = min(one, two)
                links.append((row[0], other[0]))
        waiting, many = later, 2 * many
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])


#: Lines that are held against a part at once; their characters, and pairs in question, that wait to be compared.
TOGETHER, HELD, PAIRS = 128, 1 << 23, 1 << 15


def _compare(batches):
    at, part, far, waiting, held, asked = None, _Part(), [], [], 0, 0

    def open_far() -> None:
        nonlocal far, held, asked
        if far and part.rows:
            opened = part.opened(at[0], far)
            waiting.extend((part, *x) for x in opened)
            asked += sum(len(fits) for _, fits in opened)
            held += sum(row[3] for row, _ in opened) + (sum(row[3] for row in part.rows) if opened else 0)
        far = []

    def full() -> bool:
        return held >= HELD or asked >= PAIRS

    def compared() -> pa.RecordBatch:
        nonlocal waiting, held, asked
        now, waiting, held, asked = waiting, [], 0, 0
        return _linked(now)

    for batch in batches:
        for block, number, is_far, *row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if (block, number) != at:
                open_far()
                if full():
                    yield compared()
                at, part = (block, number), _Part()
            if not is_far:
                part.rows.append(tuple(row))
                continue
            if not far and part.rows and not hasattr(part, "id"):
                part.close()
            far.append(tuple(row))
            if len(far) == TOGETHER:
                open_far()
                if full():
                    yield compared()
    open_far()
    yield compared()


def _compared(apart: DataFrame, texts: DataFrame, scope: Scope) -> DataFrame:
    """Links between lines that are apart in a large block: those outside its largest group go by every part of it."""
    main = apart.groupBy("block", "label").count().groupBy("block").agg(F.expr("max_by(label, struct(count, -label))").alias("main"), F.ceil(F.sum("count") / PART).cast("int").alias("parts"))
    own = apart.groupBy("id").agg(F.collect_set(F.struct("block", "place")).alias("blocks"))
    rows = scope.store(apart.join(main, "block").join(texts.select("id", "plain").join(own, "id"), "id"), "line-apart-texts")
    row = ("id", "label", "simhash", "size", "place", "plain", "blocks")
    one = rows.select("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("far"), *row)
    far = rows.where("label <> main").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("far"), *row)
    dealt = one.unionByName(far).repartition("block", "part").sortWithinPartitions("block", "part", "far")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def _groups(lines: DataFrame, scope: Scope) -> DataFrame:
    """(node, label) of the distinct lines that are linked with another."""
    texts = lines.where("plain is not null")
    rows = texts.select("id", "simhash", "size", "uses", F.inline(F.arrays_zip(F.col("blocks").alias("block"), F.col("places").alias("place"))))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    filed = scope.store(rows.join(sizes, "block"), "line-blocks")
    small, large = filed.where(F.col("n") <= SMALL), filed.where(F.col("n") > SMALL)
    row = ("block", "id", "simhash", "size", "place")
    a, b = _sided(small, "a", *row), _sided(small, "b", *row)
    pairs = a.join(b, (F.col("block_a") == F.col("block_b")) & (F.col("id_a") < F.col("id_b")) & _fits("a", "b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    # of edited copies the unedited line is near to most, and it is the one that occurs again
    hubs = large.groupBy("block").agg(F.expr("max_by(struct(id, simhash, size, place), struct(uses, -id))").alias("hub")).select("block", *(F.col(f"hub.{c}").alias(f"{c}_hub") for c in row[1:]))
    stars = large.select("block", *(F.col(c).alias(f"{c}_own") for c in row[1:])).join(hubs, "block").where((F.col("id_own") != F.col("id_hub")) & _fits("own", "hub"))
    stars = stars.select(F.least("id_own", "id_hub").alias("a"), F.greatest("id_own", "id_hub").alias("b"))
    links = scope.store(_verified(pairs.unionByName(stars).distinct(), texts), "line-links")
    labels = components(links, scope=scope)
    if large.limit(1).count() == 0:
        return labels
    apart = large.join(labels.withColumnRenamed("node", "id"), "id", "left").select(*row, F.coalesce("label", "id").alias("label"))
    split = apart.groupBy("block").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("block")
    apart = scope.store(apart.join(split, "block"), "line-apart")
    if apart.limit(1).count() == 0:
        return labels
    return components(links.unionByName(scope.store(_compared(apart, texts, scope), "line-links")), scope=scope)


def _rewrite(out: pa.Schema, report: bool):
    def run(batches):
        for piece, told in read_slices(batches, with_more=True):
            numbers = told.field("numbers")
            n = numbers.value_lengths().to_numpy()
            number, keep_doc, keep_line = numbers.flatten().to_numpy(), *(np.repeat(told.field(c).to_numpy(), n) for c in ("keep_doc", "keep_line"))
            rows, lines = line_places(number, line_starts(piece.text, piece.at), piece.at)
            gone = (piece.docs[rows] != keep_doc) | (lines != keep_line)
            dropped: dict[int, set] = {}
            for row, k in zip(rows[gone].tolist(), lines[gone].tolist()):
                dropped.setdefault(row, set()).add(k)
            raw, texts, counts, removed = piece.text.tobytes(), [], [], []
            for row, (a, b) in enumerate(zip(piece.at[:-1].tolist(), piece.at[1:].tolist())):
                own, text = dropped.get(row, ()), raw[a:b]
                if report:
                    counts.append(text.count(b"\n") + 1 if text else 0)
                    removed.append(len(own))
                texts.append(b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in own) if own else text)
            if report:
                columns = [piece.doc_ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(columns, schema=out)
            else:
                rest = piece.rest().combine_chunks()
                was = rest.column("text")
                now = pa.array([t.decode() if v else None for t, v in zip(texts, was.is_valid().to_pylist())], was.type)
                yield from rest.set_column(rest.schema.get_field_index("text"), "text", now).to_batches()

    return run


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _searched(docs: DataFrame, scope: Scope, keep_columns: bool) -> DataFrame:
    """The slices, each with the lines of it that are in a group and what the group keeps."""
    table = SliceTable(docs, scope, keep_columns)
    table.ask(0, _send(table.buckets), partners, "line-partners")
    met = scope.store(table.rows().mapInArrow(_meeting, _MEETING_SQL), "line-meeting")
    first = (F.any_value(c, F.lit(True)).alias(c) for c in ("simhash", "size", "blocks", "places", "plain"))
    lines = scope.store(met.groupBy("id").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.sum(F.size("numbers")).alias("uses"), *first), "line-distinct")
    labels = _groups(lines, scope)
    grouped = lines.select("id", "at", "uses").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    keepers = grouped.groupBy("label").agg(F.min("at").alias("keep"), F.sum("uses").alias("all")).where("all > 1").select("label", "keep")
    keep = scope.store(grouped.select("id", "label").join(keepers, "label").select("id", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line")), "line-keep")
    told = met.select("slice_id", "id", "numbers").join(keep, "id").groupBy("slice_id").agg(F.collect_list(F.struct("numbers", "keep_doc", "keep_line")).alias("told"))
    return table.df.join(told, "slice_id", "left")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, kept_sha256 of what is left."""
    with Scope(docs.sparkSession) as scope:
        rows = _searched(docs, scope, False)
        return scope.result(rows.mapInArrow(_rewrite(_REPORT, True), "doc_id long, n_lines long, n_removed long, kept_sha256 string"), "line-report")


def remove_lines(docs: DataFrame) -> DataFrame:
    """The documents with the repeated lines taken out of ``text``; all other columns as they are."""
    with Scope(docs.sparkSession) as scope:
        return scope.result(_searched(docs, scope, True).mapInArrow(_rewrite(None, False), docs.schema), "line-removed")
