import hashlib
import random
import re

from pyspark.sql import functions as F
from textloom.llm import pii

from .helpers import documents, odd_texts

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PLAIN.items()}


def awkward():
    rng = random.Random(3)
    pieces = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "001.2.3.255", "1.2.3.256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485 ", "+49.", "x@y", "@", ".", "😀", " ", "é", "+1 2", "9" * 40, "%+a@b-.c.d.", "mail: jo.e@x-y.co.uk,", "10.0.0.1", "--", "7"]
    return ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(120)]


def test_base_spans_match_plain_patterns(spark):
    texts = [*odd_texts(), *awkward(), "a" * 30000, "1" * 30000, "a." * 20000 + "@" + "b." * 20000 + "c", "1.1.1.1 " * 1500, "+1 " * 9000]
    got = {r.doc_id: r for r in pii.report(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = brute(text)
        named = ",".join(f"{kind}:{a}:{b}" for kind in PLAIN for a, b in want[kind])
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[kind]) for kind in PLAIN]
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("id:")) == named
    assert pii.report(documents(spark, [])).count() == 0


def test_contexts_of_seeds_find_new_identifiers(spark):
    rng = random.Random(1)
    texts = [f"please write to contact address user{k}@mail.example.com today" for k in range(12)]
    texts += [f"please write to contact address QX{k}-{rng.randrange(10**6):06d} today" for k in range(4)]
    texts += [f"the lot number QX1-{rng.randrange(10**6):06d} is old" for k in range(9)]
    got = {r.doc_id: r.spans for r in pii.report(documents(spark, texts)).collect()}
    for k in range(12, 16):
        a = texts[k].index("QX")
        assert got[k] == f"id:{a}:{texts[k].index(' today')}"
    assert all(got[k] == "" for k in range(16, 25))


def test_found_values_without_a_context_are_spans(spark):
    texts = [f"please write to contact address user{k}@mail.example.com today" for k in range(12)]
    texts += ["please write to contact address QX1-004711 today", "QX1-004711 came first", "see account:QX1-004711 there"]
    got = {r.doc_id: r.spans for r in pii.report(documents(spark, texts)).collect()}
    assert got[12] == "id:32:42"
    assert got[13] == "id:0:10"
    assert got[14] == "id:12:22"


def test_rounds_go_on_while_values_are_found(spark):
    # each pattern's known values outweigh the next step's, so a round finds one step
    sizes = [120, 60, 30, 14, 6, 2]
    value = lambda k, n: f"person{n}@mail.example.com" if k == 0 else f"QX{k}-{10000 + n}"
    texts = [f"sent to step{k} label {value(k + j, n)} now" for k in range(len(sizes) - 1) for j in (0, 1) for n in range(sizes[k + j])]
    got = {r.doc_id: r.spans for r in pii.report(documents(spark, texts)).collect()}
    assert [k for k, text in enumerate(texts) if "@" not in text and not got[k].startswith("id:")] == []


def test_tokens_outside_base_spans(spark):
    draw, parts = random.Random(3), ["a@b.co", "QX12345", "10.0.0.1", "4111 1111 1111 1111", "+49 170 1234567", "x12345@y.de", "id=AB-99887", "1234567", "word", "ZZ/12345.6789.1.2", "4111-1111-1111-1111-X99999"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", "", ",", "\n"]) for _ in range(draw.randrange(60))) for _ in range(120)] + ["", None, "a@b.co QX12345 " * 20000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = {r.doc_id: r.t for r in rows.select("doc_id", pii._spans(F.coalesce("text", F.lit("")), pii.TOKEN, F.lit(True)).alias("t")).collect()}
    for row in pii.found_spans(rows).collect():
        base = [(s.first, s.last) for kind in pii.KINDS for s in row[kind]]
        enough = [(s.first, s.last, s.value) for s in tokens[row.doc_id] if sum(c in "0123456789" for c in s.value) >= pii.MIN_DIGITS]
        got = [(s.first, s.last, s.value) for s in row.seen if not s.known]
        if row.doc_id == len(texts) - 1:
            assert len(base) == 20000 and got == enough
        else:
            assert got == [t for t in enough if not any(a < t[1] and t[0] < b for a, b in base)]
