"""Small tables that hold every awkward case."""

import random


def odd_texts() -> list:
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["é", "naïve,", "Zoë!", "漢字", "😀"]
    texts = [None, "", " ", "\n\n", "one", "a b c d", "x" * 70, "é" * 60]
    long = " ".join(rng.choice(words) for _ in range(400))
    texts += [long, long, long + " tail", "head " + long, long[:900], long[300:1500]]
    texts += ["\n".join(["same line of words here"] * 9 + ["other"]), "go " * 120, long.upper()]
    texts += [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 9, 10, 49, 50, 51, 60, 200, 3000)]
    texts += ["shared passage " + " ".join(words * 2) + f" end {k}" for k in range(3)]
    return texts


def documents(spark, texts=None, shuffle: int = 3):
    texts = odd_texts() if texts is None else texts
    rows = [(k, t, "en", f"src{k % 3}", len(t or ""), "own") for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    return spark.createDataFrame(rows, schema).repartition(shuffle)
