"""The pipeline's stages one by one against plain versions of what each must do."""

import itertools
import os
import re

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from textloom.llm import quality
from textloom.llm.shared import shared_root

from .helpers import documents, odd_texts
from .test_line_dedup import brute as brute_lines
from .test_line_dedup import texts_with_lines
from .test_minhash_decontam import brute_decontam, lower, near_copies, roots


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = [*texts_with_lines(), *near_copies(40)]
    long = [t for t in odd_texts() if t and len(t) > 900]
    items = [(1, " ".join(long[0].split()[20:35])), (2, "no such words anywhere in these documents at all today")]
    documents(spark, texts).drop("n_words").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_match_plain_versions(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen.append((name, before, docs.collect()))
    (_, before, rows), lines, near, clean, packed = seen
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(list(before.items()), "doc_id long, text string")).where("kept").collect()}
    assert {r.doc_id for r in rows} == kept and 10 < len(kept) < len(before)

    _, before, rows = lines
    ids = sorted(before)
    want = brute_lines([before[k] for k in ids])
    assert {r.doc_id: r.text for r in rows} == {k: want[n][0] for n, k in enumerate(ids)}
    assert all(r.n_chars == len(r.text) for r in rows)

    _, before, rows = near
    sets = {}
    for k, text in before.items():
        words = re.findall("[^\\x20\\x09-\\x0D]+", lower(text))
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = roots(sets, links)
    assert {r.doc_id for r in rows} == {k for k in sets if of[k] == k}

    _, before, rows = clean
    ids = sorted(before)
    want = brute_decontam([before[k] for k in ids], items)
    assert {r.doc_id for r in rows} == {k for n, k in enumerate(ids) if not want[n][4]}

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _, before, rows = packed
    tokens = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in before.items()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens


def test_the_whole_run_gives_the_last_stage(spark, folder):
    path, _ = folder
    rows = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id, r.start, r.length) for r in rows.collect()) == sorted((r.doc_id, r.start, r.length) for r in spark.read.parquet(f"{path}/packing").collect())


@pytest.mark.parametrize("empty", [True, False])
def test_nothing_but_the_result_stays(spark, folder, tmp_path, empty):
    """An empty table gives no rows; nulls and repeated rows pass through; of the folders made, the result's alone stays."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    none = docs.limit(1).select("doc_id", *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns[1:]))
    rows = docs.limit(0) if empty else docs.unionByName(none).unionByName(docs.where("doc_id < 3"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    there = lambda: set(os.listdir(shared_root(spark).removeprefix("file:")))
    before = there()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [f.split("-")[0] for f in there() - before] == ["packed"]
    assert (out == []) == empty
