import hashlib
import itertools
import random
import re

from textloom.llm import decontam, minhash
from textloom.operators.graph import components

from .helpers import documents, odd_texts


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def near_copies(n=90):
    rng = random.Random(3)
    words = [f"t{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(60)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(60)] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def test_components_are_those_of_the_graph(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 430)] + [(500, k) for k in range(501, 540)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(nodes, [p for p in links if p[0] != p[1]])


def test_near_duplicates_match_all_pairs(spark):
    texts = [*odd_texts(), *near_copies(), "a b c d", "A B C D", "a b c", "same words five here now", "same words five here now yes"]
    sets = []
    for text in texts:
        words = re.findall("[^\\x20\\x09-\\x0D]+", lower(text))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {k: (len(sets[k]), want[k], want[k] == k) for k in range(len(texts))}
    kept = minhash.keep_first(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in range(len(texts)) if want[k] == k]
    assert kept.columns == documents(spark, []).columns
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def brute_decontam(texts, items):
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for k, text in enumerate(texts):
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key]
        ids = sorted(map(str, found))
        out[k] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"v{k}" for k in range(30)] + ["Été", "don", "t"]
    items = [(10 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(25)] + [(1, ""), (2, None), (3, "a, b! c"), (4, "solo9")]
    texts = [*odd_texts(), *(" ".join(rng.choice(words) for _ in range(40)) + " " + items[k][1].upper() + " " + " ".join(rng.choice(words) for _ in range(40)) for k in range(20)), "A b-c", "x solo9 y"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_decontam(texts, items)
    for limit in (decontam.BLOCK_BYTES, 150):
        monkeypatch.setattr(decontam.blocks, "__defaults__", (limit,))
        got = {r.doc_id: tuple(r)[1:6] for r in decontam.report(documents(spark, texts), bench).collect()}
        assert got == want
        clean = decontam.remove_contaminated(documents(spark, texts), bench)
        assert sorted(r.doc_id for r in clean.collect()) == [k for k in want if not want[k][4]]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(documents(spark, texts), empty).where("contaminated").count() == 0
    assert decontam.report(documents(spark, []), bench).count() == 0


def test_repeated_and_null_doc_ids(spark):
    words = [f"w{k}" for k in range(30)]
    one, other = " ".join(words), " ".join(reversed(words))
    rows = [(4, one), (4, other), (7, one), (9, other), (None, one), (None, "alone and by itself here"), (None, None)]
    for parts in (1, 4):
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
        assert got == {(4, 26, 4, True), (7, 26, 4, False), (9, 26, 4, False), (None, 26, 4, False), (None, 1, None, True), (None, 0, None, True)}
