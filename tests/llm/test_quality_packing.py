import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
from .helpers import documents, odd_texts
from textloom.llm import packing, quality
from textloom.llm import words as W


def test_base_counts_match_a_plain_count(spark):
    got = {r.doc_id: r for r in quality.judge(documents(spark)).collect()}
    for k, text in enumerate(odd_texts()):
        text = text or ""
        words = re.findall("[^\\x20\\x09-\\x0D]+", text)
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if re.search("[^\\x20\\x09-\\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality.judge(documents(spark, [])).count() == 0


def test_repetitive_and_random_texts_go(spark):
    import random

    rng = random.Random(1)
    dull = " ".join(f"word{k % 7} in" for k in range(700))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(9)) for _ in range(300))
    prose = " ".join("".join(rng.choices("etaoinshrdlu", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3], k=rng.randrange(2, 9))) for _ in range(900))
    kept = [r.doc_id for r in quality.keep_good(documents(spark, [dull, noise, prose])).collect()]
    assert kept == [2]


def test_pieces_are_whole_and_sequences_gapless(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    texts = [*odd_texts(), "<|endoftext|>, it's x<|endoftext|>!", "Don't. ΣΑΣ, é. a,́ b", "1,2;3."]
    rows = packing.pack(documents(spark, texts), path).collect()
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(of[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(documents(spark, []), path).count() == 0


def test_patterns_meet_demand():
    import numpy as np

    rng = np.random.default_rng(0)
    demand = np.bincount(np.minimum(64, rng.geometric(0.05, 5000)), minlength=65)
    plan = packing.solve_patterns(demand, 64)
    made = np.zeros(65, int)
    for fill, times in plan:
        assert sum(s * n for s, n in fill.items()) <= 64
        for s, n in fill.items():
            made[s] += n * times
    assert (made == demand).all()
    least = int((demand * np.arange(65)).sum() / 64)
    assert sum(times for _, times in plan) <= 1.03 * least + 5


def test_added_tokens_in_any_case():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, texts = Tokenizer.from_file(path), ["<|ENDOFTEXT|>", "a <|startoftext|> b", "Plain words, here.", "x<|STARTOFTEXT|>Y <|EndOfText|>", ""]
    ids, to = packing.token_ids(*W.utf8(pa.array(texts)), path, 1)
    for k, text in enumerate(texts):
        assert ids[to[k] : to[k + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
