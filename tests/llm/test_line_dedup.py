import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from textloom.llm import line_dedup
from textloom.llm import words as W
from textloom.llm.shared import Scope
from textloom.llm.slices import SliceTable, read_slices

from .helpers import documents, odd_texts
from .test_minhash_decontam import roots


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts_with_lines():
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [line(30) for _ in range(6)]
    texts = []
    for k in range(60):
        lines = [line(rng.randrange(1, 12)) for _ in range(rng.randrange(0, 5))]
        base = rng.choice(common)
        edited = rng.choice([base, base.upper() + "!", base + f" {k}", base.replace("alpha", "alphb", 1), base])
        lines.insert(rng.randrange(len(lines) + 1), edited)
        texts.append("\n".join(lines))
    return [*odd_texts(), *texts]


def brute(texts):
    """Edit distance alone decides, between all pairs: no SimHash, no blocks."""
    places = {}
    for k, text in enumerate(texts):
        for i, line in enumerate((text or "").split("\n")):
            lowered = re.sub("[A-Z]", lambda m: m[0].lower(), line)
            plain = re.sub("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ", lowered).strip()
            if plain:
                places.setdefault(plain, []).append((k, i))
    plain = list(places)
    links = []
    for i, j in itertools.combinations(range(len(plain)), 2):
        longer = max(len(plain[i]), len(plain[j]))
        if 100 * abs(len(plain[i]) - len(plain[j])) <= 10 * longer and 100 * edit(plain[i], plain[j]) <= 10 * longer:
            links.append((i, j))
    assert links
    of, gone = roots(range(len(plain)), links), set()
    for root in set(of.values()):
        held = sorted(p for i in of if of[i] == root for p in places[plain[i]])
        gone |= set(held[1:])
    return {k: ("\n".join(x for i, x in enumerate((t or "").split("\n")) if (k, i) not in gone), sum(p[0] == k for p in gone)) for k, t in enumerate(texts)}


def one_line(text):
    return line_dedup.Lines(*W.utf8(pa.array([text])), np.array([0]))


def test_simhash_is_the_majority_of_word_bits():
    lines = one_line("alpha beta gamma delta")
    counted = [sum((1 if int(h) >> b & 1 else -1) for h in lines.hashes) > 0 for b in range(64)]
    assert int(lines.simhashes()[0]) == sum(c << b for b, c in enumerate(counted))


def test_within_agrees_with_the_table(monkeypatch):
    monkeypatch.setattr(line_dedup, "LOOK", 4)
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            b[rng.randrange(len(b) + 1) : rng.randrange(len(b) + 1)] = rng.choice(["", "x"])
        b = "".join(b)
        assert line_dedup.edits(a, b) == edit(a, b)
        assert line_dedup.within(a, b) == (100 * edit(a, b) <= 10 * max(len(a), len(b)))


#: How a line of n words is edited, all within the edit limit: one letter; a letter in a twentieth of the words; a word in
#: twelve replaced by one of at most its length.
EDITS = ["letter", "letters", "words"]


@pytest.mark.parametrize("kind", EDITS)
@pytest.mark.parametrize("n", [4, 6, 10, 20, 40, 80, 160])
def test_recall_of_edited_lines(kind, n):
    """The share of pairs within the edit distance that the blocks and the SimHash let through, told without either."""
    rng, found, within = random.Random(n), 0, 0
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    for _ in range(60):
        line = [word() for _ in range(n)]
        other, times = list(line), {"letter": 1, "letters": max(1, n // 20), "words": max(1, n // 12)}[kind]
        for k in rng.sample(range(n), times):
            at = rng.randrange(len(line[k]))
            other[k] = word()[: len(line[k])] if kind == "words" else line[k][:at] + "q" + line[k][at + 1 :]
        a, b = " ".join(line), " ".join(other)
        if a == b or not line_dedup.within(a, b):
            continue
        within += 1
        one, two = one_line(a), one_line(b)
        _, block, place = one.blocks(one.sizes())
        _, other_block, other_place = two.blocks(two.sizes())
        _, i, j = np.intersect1d(block, other_block, return_indices=True)
        found += line_dedup.candidates(one.simhashes(), two.simhashes(), one.sizes(), two.sizes(), place[i], other_place[j]).any() if len(i) else False
    assert within == 0 or found >= 0.9 * within


@pytest.mark.parametrize("small", [16, 1])
def test_lines_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "PART", 2048 if small > 1 else 3)
    texts = texts_with_lines()
    want = brute(texts)
    rows = {r.doc_id: r for r in line_dedup.remove_lines(documents(spark, texts, 7)).collect()}
    assert {k: r.text for k, r in rows.items()} == {k: None if texts[k] is None else t for k, (t, _) in want.items()}
    assert all((r.n_words, r.lang) == ("own", "en") for r in rows.values())
    if small > 1:
        got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup.report(documents(spark, texts)).collect()}
        assert got == {k: (n, hashlib.sha256(t.encode()).hexdigest()) for k, (t, n) in want.items()}


def test_an_empty_table(spark):
    assert line_dedup.report(documents(spark, [])).count() == 0
    assert [r.text for r in line_dedup.remove_lines(documents(spark, [None])).collect()] == [None]


def test_repeated_short_lines_go(spark):
    texts = ["All rights reserved\nfirst", "ALL RIGHTS RESERVED.\nsecond", "third\nall rights reserved", "a\n-\n\nnext", "a!\n-\n\nlast"]
    got = [r.text for r in line_dedup.remove_lines(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["All rights reserved\nfirst", "second", "third", "a\n-\n\nnext", "-\n\nlast"]


def test_lines_that_differ_in_most_digits_stay(spark):
    rows = ["1839 2744 9012 5521 7716 0034", "4402 1187 3365 9908 2214 6650"]
    near = ["page seen at 10 31 by the reader of the day", "page seen at 10 32 by the reader of the day"]
    got = [r.text for r in line_dedup.remove_lines(documents(spark, [*rows, rows[0], *near])).orderBy("doc_id").collect()]
    assert got == [*rows, "", near[0], ""]


def test_a_line_of_one_word_again_and_again(spark):
    texts = ["go " * 200, "GO " * 200 + "\nother words", "stay here"]
    got = [r.text for r in line_dedup.remove_lines(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0], "other words", "stay here"]


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "a line of five words\nmore", "x", "y", "z"), (1, "a line of five words\nless", "x", "y", "z"), (None, "a line of five words", "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _id string, slice_text string")
    got = sorted(line_dedup.remove_lines(docs).collect(), key=lambda r: (r.doc_id is None, r.text))
    # rows with one doc_id are one document, whose first line stays in both
    assert [r.text for r in got] == ["a line of five words\nless", "a line of five words\nmore", ""]
    assert all((r["_text"], r["_id"], r["slice_text"]) == ("x", "y", "z") for r in got)


def test_session_and_catalog_are_left_as_they_were(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before, tables = [spark.conf.get(n) for n in names], len(spark.catalog.listTables())
    line_dedup.report(documents(spark)).count()
    assert [spark.conf.get(n) for n in names] == before and len(spark.catalog.listTables()) == tables


def test_pairs_compared_together_are_within_as_pair_by_pair():
    rng = random.Random(5)
    ones, others = ["", "a", "", "x" * 2600], ["", "", "abc", "x" * 2599 + "y"]
    for _ in range(1500):
        one = "".join(rng.choice("abcé 😀") for _ in range(rng.randint(1, 160)))
        other = list(one)
        for _ in range(rng.randint(0, 18)):
            k = rng.randint(0, len(other))
            other[k : k + rng.randint(0, 1)] = rng.choice(("", "z", "é", "ab"))
        ones.append(one)
        others.append("".join(other))
    limits = [line_dedup.EDIT_PERCENT * max(len(a), len(b)) // 100 for a, b in zip(ones, others)]
    want = [line_dedup.edits(a, b) <= n for a, b, n in zip(ones, others, limits)]
    assert 300 < sum(want) < 1300 and line_dedup.all_within(ones, others).tolist() == want


def test_lines_are_worked_out_once_and_texts_kept_once(spark, monkeypatch):
    """Of lines without a partner nothing comes back, those with one are the only ones worked out again, and the other
    columns of a slice don't hold the text a second time."""
    text = "\n".join(f"line {k} of words {k * 7} nobody {k * k} else {k + 5} has {k * 13} here {k}" for k in range(200))
    texts = [text, "one line that is met again by a near one here\nx y", "one line that is met again by a near one hera\nx y"]
    at = np.cumsum([0, *(len(t) for t in texts)])
    lines = line_dedup.Lines(np.frombuffer("".join(texts).encode(), np.uint8), at, np.array([3, 2, 1]))
    (reply,) = line_dedup.partners([line_dedup._packed(line_dedup._again(lines), line_dedup._entries(lines))])
    again, near, same = line_dedup._unpacked(reply, line_dedup._AGAIN, line_dedup._NEAR, "<u4")
    # the line that stands for equal ones is that of the least document
    assert again.tolist() == [(201, 203)] and set(near["number"].tolist()) == {200, 202} and not len(same)

    seen = []
    monkeypatch.setattr(line_dedup, "Lines", lambda text, at, docs, made=line_dedup.Lines: seen.append(len(text)) or made(text, at, docs))
    table = pa.table({"slice_id": [0], "doc_ids": [[3, 2, 1]], "offsets": [at.astype(np.int64).tobytes()], "text": [zstandard.compress("".join(texts).encode())], "rest": pa.array([None], pa.binary()), "size": [int(at[-1])], "answers": [[{"level": 0, "bucket": 0, "reply": reply}]]})
    (met,) = line_dedup._meeting(table.to_batches())
    assert sum(seen) < 200 and sorted(met.column("numbers").to_pylist()) == [[200], [202], [203, 201]]

    with Scope(spark) as scope:
        rest = [s.rest() for s in read_slices(SliceTable(documents(spark, ["some text", None, ""]), scope, True).df.toArrow().to_batches())]
    assert sorted("null" if t is None else t for r in rest for t in r.column("text").to_pylist()) == ["", "", "null"]


def test_pairs_that_cannot_keep_their_limit_are_left_out(monkeypatch):
    """Of texts that part early nothing is filled in to the end, and what is told of any pair stays the same."""
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    ones, others = [], []
    for k in range(300):
        one = line(rng.randint(1, 900))
        spoiled = "".join(rng.choice(("", c, c + "x", "y")) if rng.random() < rng.choice((0.02, 0.1, 0.15, 0.3)) else c for c in one)
        ones.append(one)
        others.append(rng.choice((spoiled, line(len(one)), one[40:] + one[:40])))
    limits = np.array([line_dedup.EDIT_PERCENT * max(len(a), len(b)) // 100 for a, b in zip(ones, others)])
    want = [line_dedup.edits(a, b) <= n for a, b, n in zip(ones, others, limits.tolist())]
    assert line_dedup._banded(ones, others, limits).tolist() == want and 0 < sum(want) < 300
    # two long texts without a letter in common are told by the first look
    looks, minimum = [], np.minimum
    monkeypatch.setattr(line_dedup.np, "minimum", lambda *a, **k: looks.append(1) or minimum(*a, **k))
    assert not line_dedup._banded(["a" * 1000] * 8, ["b" * 1000] * 8, np.full(8, 100)).any()
    assert len(looks) < 1500
