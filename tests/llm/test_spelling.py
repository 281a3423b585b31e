"""Word counts and variants against plain Python over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from textloom.llm import spelling

from .helpers import documents, odd_texts


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_words(rows) -> dict[str, int]:
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n: dict[str, int]) -> list[tuple]:
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def held(spark, counts: dict[str, int], bucket: int):
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(tuple(r) for r in spelling.variants(table, bucket).collect()) == plain_variants(counts)


def dense(seed: int) -> dict[str, int]:
    """Words over few letters, so that most are near many, with doubled letters, accents and chains of forms."""
    rng = random.Random(seed)
    out = {"".join(rng.choice("abé") for _ in range(rng.choice((5, 6, 7)))): rng.choice((3, 4, 6, 7, 14, 30, 61)) for _ in range(150)}
    out |= {"shared" + "".join(rng.choice("xyz") for _ in range(rng.choice((5, 6)))): rng.randrange(3, 200) for _ in range(80)}
    return out | {"aaaaa": 3, "aaaaaa": 9, "aaaaaaa": 30, "q" * 40: 3, "q" * 41: 8, "q" * 20 + "r" + "q" * 19: 5}


@pytest.mark.parametrize("bucket", [2, 1000])
def test_all_pairs_whatever_the_bucket(spark, bucket):
    held(spark, dense(bucket), bucket)


def test_words_of_whole_texts(spark):
    rng = random.Random(3)
    vocabulary = ["Reihe", "naïve", "Éclair", "straße", "×times÷", "ordinary", "ordinry", "x" * 30]
    texts = [*odd_texts(), *(" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(40)), "ordinary-" * 20_000]
    rows = [(None if k == 11 else k, t) for k, t in enumerate(texts)]
    table = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert {r.word: r.n for r in spelling.words(table).collect()} == plain_words(rows)
    assert sorted(tuple(r) for r in spelling.group_variants(table).collect()) == plain_variants(plain_words(rows))


def test_nothing_to_group(spark):
    assert spelling.group_variants(documents(spark).limit(0)).collect() == []
    held(spark, {"alone": 3}, 4)
    held(spark, {"alone": 3, "other": 3}, 4)


def test_a_shared_beginning_is_split(spark):
    """A third of all words begin alike: no join meets them all."""
    rng = random.Random(9)
    counts = {"commonstart" + "".join(rng.choice("abcdefghij") for _ in range(8)): 3 for _ in range(400)}
    counts |= {w[:-1] + "k": 9 for w in list(counts)[:50]} | {"".join(rng.choice("klmnop") for _ in range(9)): 5 for _ in range(200)}
    held(spark, counts, 6)
