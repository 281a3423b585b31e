"""Picture candidates on worked pages and against a plain reader of srcset and img tags."""

import random
import re

from pyspark.sql import functions as F

from textloom.operators import pictures as P

FIXTURE = """<html><head>
 <meta property="og:image" content="https://cdn.example.com/images/hero-1600.jpg" />
 <meta content='/images/tw &amp; 1200.jpg' name="twitter:image" />
 <script type="application/ld+json">{"@type":"NewsArticle","image":{"url":"https://cdn.example.com/images/schema-1400.jpg"}}</script>
</head><body><img src="thumb-small.jpg" width="100"/><img src="//cdn.example.com/body.jpg?x=1" width="900px" alt="A big Fire"/><img src="https://cdn.example.com/BODY.jpg" width="300"/>
<img src="a.jpg" class="site-logo"/><img src="data:image/gif;base64,x"/><img data-src="late.jpg" src="early.jpg"/>
<img srcset="https://cdn.example.com/src-640.jpg 640w, https://cdn.example.com/src-1280.jpg 1280w, https://cdn.example.com/other.jpg 1280w"/><img srcset="no.jpg 2x"/></body></html>"""


def found(spark, html, base, f=P.candidates):
    return spark.createDataFrame([(html, base)], "html string, url string").select(f(F.col("html"), F.col("url")).alias("c")).first().c


def test_places_order_and_addresses(spark):
    got = [(c.place, c.url, c.width) for c in found(spark, FIXTURE, "https://example.com/news/story?a=b")]
    assert got == [
        ("og:image", "https://cdn.example.com/images/hero-1600.jpg", 0), ("twitter:image", "https://example.com/images/tw%20&%201200.jpg", 0), ("schema", "https://cdn.example.com/images/schema-1400.jpg", 0),
        ("srcset", "https://cdn.example.com/src-1280.jpg", 1280), ("body", "https://cdn.example.com/body.jpg?x=1", 900), ("body", "https://cdn.example.com/BODY.jpg", 300), ("body", "https://example.com/news/late.jpg", 0),
    ]
    distinct = found(spark, FIXTURE, "https://example.com/news/story", lambda h, u: P.distinct(P.candidates(h, u)))
    assert [c.url for c in distinct if "ody" in c.url] == ["https://cdn.example.com/body.jpg?x=1"]
    assert found(spark, None, "https://e.org") == found(spark, "", None) == [] and len(found(spark, '<img src="x.jpg">', None)) == 1


def test_a_publishers_own_pictures(spark):
    toi = "https://timesofindia.indiatimes.com/world/story/example/articleshow/129310476.cms"
    own = '<img src="https://static.toiimg.com/thumb/msid-{},width-1280,height-720,resizemode-6/photo.jpg" />'
    got = found(spark, '<meta property="og:image" content="https://example.com/generic.jpg"/>' + own.format(999999) + own.format(129310476), toi)
    assert [(c.place, "129310476" in c.url) for c in got] == [("source:toi", True), ("og:image", False), ("body", True)]
    assert len(found(spark, own.format(999999), toi)) == 1  # nothing else would be left
    base = "https://www.indiatoday.in/world/story/norway-storm-closes-schools-2890123-2026-01-02"
    pic = "https://akm-img-a-in.tosshub.com/indiatoday/images/story/202601/{}-16x9_0.jpg"
    html = " ".join(f'"{pic.format(n)}"' for n in ("norway-storm", "norway-only", "norway-storm-screenshot_1")) + f'<img src="{pic.format("other-event")}">'
    assert [(c.place, c.url) for c in found(spark, html, base)] == [("source:indiatoday", pic.format("norway-storm"))]


def plain_widest(srcset):
    best = ("", 0)
    for part in (p.strip() for p in srcset.split(",")):
        chunks = part.split()
        width = int(chunks[1][:-1]) if len(chunks) > 1 and re.fullmatch("[0-9]+w", chunks[1]) else 0
        if chunks and width > best[1]:
            best = (chunks[0], width)
    return best if best[0] else None


def test_widest_of_any_srcset(spark):
    rng = random.Random(6)
    sets = [",".join(rng.choice(("a.jpg 640w", " b.jpg  1280w ", "c.jpg 2x", "d.jpg", "", "e.jpg 1280w", "f.jpg xw", "g.jpg 9w x")) for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "k int, s string").select("k", P.widest(F.col("s")).alias("w")).orderBy("k").collect()
    assert [r.w and (r.w.url, r.w.width) for r in rows] == [plain_widest(s) for s in sets]


def test_other_addresses_of_a_picture(spark):
    cases = {
        "https://static.toiimg.com/photo/123.cms": ["https://static.toiimg.com/thumb/msid-123,width-1600,height-900,resizemode-6/photo.jpg", "https://static.toiimg.com/thumb/msid-123,width-1280,height-720,resizemode-6/photo.jpg", "https://static.toiimg.com/photo/123.cms"],
        "https://i.guim.co.uk/img/a.jpg?width=300": ["https://i.guim.co.uk/img/a.jpg?width=1600&dpr=1&s=none&crop=none", "https://i.guim.co.uk/img/a.jpg?width=1200&dpr=1&s=none&crop=none", "https://i.guim.co.uk/img/a.jpg?width=300", "https://i.guim.co.uk/img/a.jpg"],
        "https://a.org/x y.jpg?w=9&overlay-align=b&k=logo": ["https://a.org/x%20y.jpg?w=9&overlay-align=b&k=logo", "https://a.org/x%20y.jpg?w=9", "https://a.org/x%20y.jpg"],
        "https://static.toiimg.com/thumb/msid-1,overlay-toi_sw,pt-32,width-9/p.jpg": ["https://static.toiimg.com/thumb/msid-1,overlay-toi_sw,pt-32,width-9/p.jpg", "https://static.toiimg.com/thumb/msid-1,width-9/p.jpg"],
        "": [], None: [],
    }
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "k int, u string").select("k", P.download_urls(F.col("u")).alias("d")).orderBy("k").collect()
    assert [r.d for r in rows] == list(cases.values())
