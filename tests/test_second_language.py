"""Copy in a second language, held against plain versions."""

import re

from pyspark.sql import functions as F

from textloom.functions import second_language as L


def clean(text):
    out = re.sub(r" +([,.;:!?।])", r"\1", " ".join((text or "").split()).replace("’", "'").replace("“", '"').replace("”", '"'))
    for word, own in L.REPLACED.items():
        out = re.sub(rf"(?i)(?<![^\W]){word}(?![^\W])", own, out)
    return out


def stop_at(text):
    return max(text.rfind(m) for m in L.STOPS)


def ended(text, least, most):
    text = clean(text).rstrip(" ,:-")
    if not text or text[-1] in L.STOPS:
        return text
    if stop_at(text) >= least - 25:
        return text[: stop_at(text) + 1]
    for closure in L.CLOSURES:
        if len(text) + len(closure) <= most:
            return text + closure
    at = text.rfind(" ")
    text = (text[:at] if at > 0 else text).rstrip(" ,:-")
    return text if not text or text[-1] in L.STOPS else text + "."


def longer(text, least, most):
    for k in range(12):
        tail = L.TAILS[k % 6]
        if len(text) >= least or len(text) + len(tail) > most:
            break
        text = clean(text + tail)
    return text


def plain_fit(text, least=299, most=350):
    text = longer(clean(text), least, most)
    if len(text) > most:
        head = text[:most]
        if stop_at(head) >= least - 30:
            text = head[: stop_at(head) + 1]
        else:
            at = head.rfind(" ")
            text = (head[:at] if at > 0 else head).rstrip(" ,.-")
    return ended(longer(ended(text, least, most), least, most), least, most)


def test_fit_against_the_plain_version(spark):
    words = ["వర్షాలు", "పోలీసులు.", "impact", "Tension,", "చర్చలు", "dialogue", "నగరం!", ":", "-", "ab", "రైతులు।", "UN"]
    texts = [None, "", " ", ".", "x" * 400, "ab " * 200, "impact impact", "a  b ,c", "వ" * 349, "వ" * 350 + ".", "y" * 320 + ". " + "z " * 60, "y" * 280 + ". " + "z " * 60, "y" * 60 + " impacts", ", : -"]
    texts += [" ".join(words[(k * 7 + j * (k % 5 + 1)) % 12] for j in range(k % 70)) for k in range(140)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", L.fitted("t").alias("f")).collect()
    assert {r.k: r.f for r in got} == {k: plain_fit(t) for k, t in enumerate(texts)}
    # a text without a space may get its stop beyond the band
    assert all(len(r.f) <= 351 for r in got)


def test_title_and_left_over(spark):
    rows = spark.createDataFrame([("రైతులు , పోలీసులు : : x,", "Anna Lee met the UN. Said O'Hara's.", "UN అన్నా anna said ok lee The"), (None, None, None), ("", "", "వర్షాలు ab")], "t string, s string, c string")
    out = rows.select(L.title("t").alias("t"), L.left_over("c", L.kept_words(F.lit(None).cast("string"), "s")).alias("r"), L.purity("c").alias("p")).collect()
    assert out[0].t == "రైతులు: పోలీసులు: x" and out[1].t == "" == out[2].t
    assert [(r.r.words, round(r.r.share, 4), r.r.found) for r in out] == [(3, round(3 / 7, 4), True), (0, 0.0, False), (1, 0.5, False)]
    assert out[1].p == 0.0 and round(out[2].p, 4) == round(100 * 7 / 9, 4)
