"""Desk, sentence, link, image and ranking rules on worked cases, with nulls and empty values."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from textloom.functions import desk_lexicons as D
from textloom.operators import desk as K
from textloom.operators import images as I
from textloom.operators import links as H
from textloom.operators import sentences as Z
from textloom.operators import stories as S

FIELDS = "title string, body string, source string, source_url string, url string, category string"


def desks(spark, *rows):
    return [r.desk for r in K.desks(spark.createDataFrame(rows, FIELDS)).collect()]


def test_desks(spark):
    at = ("", "")
    got = desks(
        spark, ("Judges weigh AI rights", "Creative rights and artificial intelligence are in dispute.", "Guardian", *at, "tech"), ("Dubai charity feeds thousands", "Volunteers served meals in Dubai.", "TOI", "https://x.org/world", "", "international"),
        ("Mayor opens bridge", "It spans the Tapti.", "TOI", *at, "national"), ("Floods in Guntur", "Roads are closed.", "BBC", *at, "international"), (None, None, None, None, None, None), ("Council meets", "It met.", "BBC", *at, "national"),
    )
    assert got == ["Technology", "International", "National", "State", "International", "International"]


def test_labels_and_answers(spark):
    rows = spark.createDataFrame([(" Crime ",), ("Sports",), (None,), ("tech",)], "v string").select(K.known_label(F.col("v")).alias("l"), K.proposed(F.col("v")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("National", None), ("Sports", "Sports"), ("National", None), ("Technology", None)]


def test_prose(spark):
    rows = spark.createDataFrame([("One  two <b>three</b>. - Ends Published By: A B",), ("He left. In 2024 Anna Lee spoke to Bob Ray. Rain fell in 2023.",), (None,), ("",)], "b string")
    out = rows.select(Z.clean_body("b").alias("c"), Z.best_lede(F.col("b")).alias("l"), Z.too_thin(Z.clean_body("b")).alias("t")).collect()
    assert out[0].c == "One two three ." and out[1].l == "In 2024 Anna Lee spoke to Bob Ray." and out[2].c == out[3].c == "" and out[2].l is None and all(r.t for r in out)
    tags = spark.createDataFrame([("#A, #a b",), (None,), (" ,",)], "v string").select(Z.keyword_list(F.col("v")).alias("k")).collect()
    assert [r.k for r in tags] == [["A", "b"], ["news"], ["news"]]


def test_prose_is_what_all_patterns_leave(spark):
    ends = ["- Ends here", " -ENDS", "Published by: A", "published ON : now", "Also\t Read | more", "story continues  below this ad x", "ADVERTISEMENT", "Read more at toi x", "forthcoming stories", "Subscribe to India Today", "Get latest news on x", "watch live", "Follow  us on x", "Weekends here", "also ready"]
    marks = ["<b>x</b>", "<script a>v < 1;</script>", "(function (a) { b } ) (c);", "x.createElement('a');", "e.appendChild", "window.a = 1;", "d.head.b;", "v.location.c", "'//cdn.a.com/b.js'", "a // b", "1 < 2", "document .x"]
    texts = [f"Rain fell. {m} Sun\n shone. {e}" for e in ["", *ends] for m in ["", *marks]]

    def plain(text):
        squeeze = lambda x: re.sub(r"[ \t\n\x0B\f\r]+", " ", x).strip(" ")
        out = squeeze(text)
        for p in D.TAILS:
            out = re.sub("(?is)" + p, "", out).strip(" ")
        for p in D.SCRIPTS:
            out = re.sub(p, " ", out)
        return squeeze(out)

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, b string").select("k", Z.clean_body("b").alias("c")).orderBy("k").collect()
    assert [r.c for r in rows] == [plain(t) for t in texts]


def test_links(spark):
    html = '<a href="/world/2023/may/3/a"><a href="/world/2024/jan/13/b"><a href="/world/2024/jan/2/c"><a href="/world/2024/jan/13/b">' + "<a href='/india-news/x-123456'><a href='/india-news/y-123456?ref=/video&amp;a=&quot;'><a href='/video/z-123456'>"
    got = {}
    for r in H.by_publisher(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("pos").collect():
        got.setdefault((r.page_id, r.publisher), []).append(r.link)
    base = "https://www.theguardian.com/world/"
    assert got == {(1, "guardian"): [base + "2024/jan/13/b", base + "2024/jan/2/c", base + "2023/may/3/a"], (1, "ndtv"): ["https://www.ndtv.com/india-news/x-123456", 'https://www.ndtv.com/india-news/y-123456?ref=/video&a="']}


def test_images(spark):
    urls = ("https://a.org/x.jpg", "https://a.org/logo.jpg", "https://a.org/x.svg", "https://a.org/x.jpg?w=219", "https://a.org/x.jpg?w=220", "https://a.org/x.jpg?watermark", None)
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string").select("k", I.blocked(F.col("u")).alias("b")).orderBy("k").collect()
    assert [r.b for r in rows] == [False, True, True, True, False, True, False]
    reasons = spark.createDataFrame([(["odd", "blur_detected", "resolution_too_low"],), (["odd"],), ([],)], "r array<string>").select(I.main_reason(F.col("r")).alias("m")).collect()
    assert [r.m for r in reasons] == ["resolution_too_low", "odd", "download_failed"]


def test_same_event_and_keys(spark):
    titles = spark.createDataFrame([(1, "US warns China over Taiwan", "by 2027"), (2, "Taiwan window for China in 2027", "2027 window"), (3, "China builds 2027 ships", "2027"), (4, None, None)], "id long, title string, text string")
    # 2 has the number in its title, 1 in its text alone; 5 and 6 retell 2
    more = titles.unionByName(spark.createDataFrame([(5, "China over Taiwan", "in 2027"), (6, "Taiwan, China and US", "2027"), (7, "Taiwan China", "20270")], titles.schema))
    assert sorted((r.new_id, r.old_id) for r in S.same_event(more, more).collect()) == [(5, 2), (6, 2)]
    clusters = spark.createDataFrame([(70000, "B"), (5, "A"), (9, "C")], "cluster_id long, title string")
    assert {r.cluster_id: r.number for r in S.cluster_keys(clusters).collect()} == {5: 1, 9: 2, 70000: 3}


def test_every_retold_title(spark):
    """Not the first alone: each earlier title with two names and a number of its own in common, equal titles too."""
    rows = spark.createDataFrame([
        (1, "US warns China over Taiwan 2027", ""), (2, "Taiwan window for China in 2027", ""), (3, "Taiwan window for China in 2027", ""), (4, "China builds 2027 ships", ""),
        (5, "US and China over Taiwan", "2027, 300 and 2027"), (6, "Taiwan China US 300", "2027"), (7, None, None),
    ], "id long, title string, rest string").withColumn("text", F.concat_ws(" ", "title", "rest"))
    got = sorted(tuple(r) for r in S.retold(rows, rows).collect())
    assert got == [(2, 1, 2), (3, 1, 2), (3, 2, 2), (5, 1, 3), (5, 2, 2), (5, 3, 2), (6, 1, 3), (6, 2, 2), (6, 3, 2)]


def test_pool_order(spark):
    day = datetime(2024, 1, 1)
    rows = [(1, "c", True, 2, 0.5, day, 1), (2, "c", True, 2, 0.9, day, 1), (3, "c", False, 2, 0.9, day, 2), (4, "c", False, 2, 0.1, day, 0), (5, "c", True, 2, 0.9, day, 0)]
    got = S.pool_order(spark.createDataFrame(rows, "cluster_id long, category string, breaking boolean, priority int, confidence double, end_ts timestamp, source_rank int")).collect()
    assert {r.cluster_id: r["rank"] for r in got} == {5: 1, 2: 2, 1: 3, 4: 1, 3: 2}


def test_low_value_works_a_sentence_out_once(spark):
    assert str(Z.low_value(F.col("s"))).count("regexp_replace") == 1
    rows = spark.createDataFrame([(None,), ("",), ("Rain fell  in Oslo.",)], "s string").select(Z.low_value(F.col("s")).alias("l")).collect()
    assert [r.l for r in rows] == [False, False, False]
