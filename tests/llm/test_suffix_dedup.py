import hashlib
import random

import numpy as np
import pytest
from textloom.llm import suffix_dedup

from .helpers import documents, odd_texts


@pytest.mark.parametrize("budget", [1 << 30, 64])
def test_suffix_order(budget):
    rng = random.Random(2)
    cases = [b"banana", b"a", b"aaaaaaaa", b"abababab", bytes([255, 0, 255, 0, 0, 255]), bytes(range(256)), bytes(range(255, -1, -1))]
    cases += [bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 200))) for _ in range(60)]
    cases += [bytes(rng.choice(b"the of and") for _ in range(1500)), b"ab" * 20 + bytes(rng.choice(b"abc") for _ in range(300)) + b"c" * 90 + b"b" * 70]
    for text in cases:
        got = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), 50, budget).tolist()
        assert sorted(got) == list(range(len(text)))
        keys = [text[i : i + 50] for i in got]
        assert keys == sorted(keys), text


def brute(texts, width=50):
    raw = [(t or "").encode() for t in texts]
    first = {}
    for k, t in enumerate(raw):
        for i in range(len(t) - width + 1):
            first.setdefault(t[i : i + width], k)
    out = {}
    for k, t in enumerate(raw):
        hit = [False] * len(t)
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] < k:
                hit[i : i + width] = [True] * width
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        kept = bytes(b for b, h in zip(t, hit) if not h)
        out[k] = (len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 17])
def test_removed_bytes_match_brute_force(spark, parts):
    rng = random.Random(6)
    words = [f"k{k}" for k in range(50)] + ["ñandú", "漢字"]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = [*odd_texts(), "z" * 49, "z" * 50, "z" * 51, "y" * 500, "y" * 120]
    for _ in range(25):
        cut = passage[rng.randrange(0, 60) : len(passage) - rng.randrange(0, 60)]
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) + cut + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))))
    rows = suffix_dedup.remove_repeats(documents(spark, texts).repartition(parts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute(texts)
    for r in rows:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed and len(r.spans) == 2 * r.n_spans


def test_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0
    assert suffix_dedup.remove_repeats(documents(spark, [None, "", "x"])).where("n_removed > 0").count() == 0


def test_only_runs_that_may_share_a_window_are_sorted(monkeypatch):
    """Copies are merged and what stands alone is told apart before any suffix is sorted; periodic runs, too."""
    rng, sorted_bytes = random.Random(5), []
    plain = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda raw, *more: sorted_bytes.append(len(raw)) or plain(raw, *more))

    def repeats(runs):
        raw = [r for r, _ in runs]
        docs, sizes = np.array([d for _, d in runs]), np.array([len(r) for r in raw])
        grams = suffix_dedup.W.mix(np.array([suffix_dedup._least_grams(np.frombuffer(r, np.uint8), 50)[0] for r in raw]))
        got = suffix_dedup._repeats(docs, grams, sizes, np.frombuffer(b"".join(raw), np.uint8), 50, 1 << 20)
        first = {}
        for r, d in runs:
            for i in range(len(r) - 49):
                first[r[i : i + 50]] = min(d, first.get(r[i : i + 50], d))
        assert got.tolist() == [first[r[i : i + 50]] < d for r, d in runs for i in range(len(r) - 49)]

    def runs_of(text):
        least = suffix_dedup._least_grams(np.frombuffer(text, np.uint8), 50)
        cuts = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(least)]
        return [text[a : b + 49] for a, b in zip(cuts, cuts[1:])]

    text = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    repeats([(r, d) for d in (3, 1, 2) for r in runs_of(text)])
    assert not sorted_bytes
    for _ in range(40):
        word = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30)))
        texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randrange(40))) + word * rng.randrange(1, 200 // len(word) + 2) + text[: rng.randrange(90)] for _ in range(4)]
        runs = [(r, d) for d, t in enumerate(texts) if len(t) >= 50 for r in runs_of(t)]
        if runs:
            repeats(runs)
    assert sorted_bytes


def test_buckets_get_even_shares():
    """The hash by which runs are dealt is the least of some 35, yet no bucket gets more than its share."""
    text = np.random.default_rng(1).integers(97, 123, 200_000, np.uint8)
    ids, at = suffix_dedup.pa.array([1]), np.array([0, len(text)])
    piece = suffix_dedup.Slice(0, ids, at.tobytes(), suffix_dedup.zstandard.compress(text.tobytes()), None, None)
    grams = np.sort(suffix_dedup._Windows(piece, 50, 8, False).grams)
    counts = suffix_dedup.bucket_counts(grams, 32)
    assert counts.sum() > 9000 and counts.max() < 1.5 * counts.mean()
