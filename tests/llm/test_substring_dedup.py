import hashlib
import random
import re

import pytest
from textloom.llm import substring_dedup
from textloom.llm import words as W

from .helpers import documents, odd_texts


def brute(texts, width=50):
    first, out = {}, {}
    listed = [re.findall("[^\\x20\\x09-\\x0D]+", t or "") for t in texts]
    for words in listed:
        for i in range(len(words) - width + 1):
            first.setdefault(tuple(words[i : i + width]), len(out))
        out[len(out)] = None
    for k, words in enumerate(listed):
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < k:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[k] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 20])
def test_removed_words_match_brute_force(spark, parts):
    rng = random.Random(8)
    words = [f"q{k}" for k in range(60)] + ["ñandú"]
    passage = [rng.choice(words) for _ in range(70)]
    texts = odd_texts()
    for k in range(25):
        cut = passage[rng.randrange(0, 20) : 70 - rng.randrange(0, 25)]
        texts.append(" ".join([rng.choice(words) for _ in range(rng.randrange(0, 90))] + cut + [rng.choice(words) for _ in range(rng.randrange(0, 90))]))
    frame = documents(spark, texts)
    frame = frame.repartition(parts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame).collect()}
    assert got == brute(texts)


def test_nothing_in_nothing_out(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(documents(spark, [None, "", " a  b "])).collect()}
    assert got == {0: "", 1: "", 2: "a b"}


def test_windows_of_runs():
    import numpy as np

    values = np.arange(40, dtype=np.uint64)
    for width in (1, 2, 3, 7, 25):
        rolled = W.rolled(values, width)
        assert len(rolled) == 41 - width == len(set(rolled.tolist()))
        assert (W.rolled(values[5:], width) == rolled[5:]).all()
        assert W.sliding_min(values, width).tolist() == values[: 41 - width].tolist()
