"""Cascades against plain readers of each publisher's rules."""

import html as entities
import random
import re

from pyspark.sql import functions as F

from textloom.operators import extraction as X

LOOSE, STRICT = ("BBC", "AlJazeera", "NDTV", "India Today"), ("TOI", "Reuters", "Guardian", "The Hindu")
LONG = "The navy brought the whole crew of the burning tanker to safety on Friday night after a long search, it said in a note. "
HEADS = (
    '<meta property="og:title" content="Gold price jumps in Mumbai | BBC News"/>', "<meta content='Storm shuts &amp; floods schools - NDTV' data-x=1 property='og:title'>", '<meta content="Court hears case of deportees | Times of India" property="og:title">',
    '{"headline": "Tankers leave the strait - Reuters World"}', "<title>Short | The Hindu</title>", "<title>Bank of Japan holds its rate | The Hindu</title>", "<h1 class='a'>Norway storm closes all schools - Al Jazeera</h1>", '<meta property="og:title" content="tiny">',
    '<meta property="og:description" content="' + LONG[:90] + '"/>', "<meta name='description' content='" + LONG[:60] + "'>", '<meta name="description" content="' + LONG + '">', '<meta content="' + LONG[:110] + '" property="og:description">',
    '{"articleBody": "' + LONG * 2 + '\\nEnd\\u0027s"}', '{"description" : "' + LONG[:85] + '"}', '{"summary":"' + LONG[:82] + '"}', "<time class=x datetime='2024-01-02'>", '<time id="a" datetime="2024-03-04">', '{"datePublished":"2024-05-06T07:08"}', '{"DatePublished":"2024-06-06"}',
    '{"image": {"@type": "x", "url": "https://a.org/object.jpg"}}', '{"image": "https://a.org/plain.jpg"}', '<meta property="og:image" content="https://timesofindia.indiatimes.com/photo/123.cms"/>', '<meta property="og:image" content="/relative.jpg"/>',
    '<meta name="twitter:image" content="https://a.org/t.svg?a=1&amp;b=2"/>', '<meta content="https://a.org/turned.jpg" property="og:image"/>',
)
PARTS = ("<p>" + LONG + "</p>", "<P class='x'>Upper " + LONG[:60] + "</P>", "<p>Copyright " + LONG + "</p>", "<p>short</p>", "<p>A <b>bold</b> claim &amp; another one that is told here\n at  length for all</p>", "<pre>" + LONG[:70] + "</pre></p>", "<p>Read more and read all about it: advertisement, newsletter</p>")


def clean(t):
    t = entities.unescape(t or "").replace("\\n", " ").replace("\\u0027", "'").replace('\\"', '"')
    return re.sub(r"\s+", " ", t).strip()


def plain(page, name):
    loose = name in LOOSE
    q, gap = ("[\"']", "[^>]+") if loose else ('"', r"\s+")
    inner = "[^\"']+" if loose else '[^"]+'
    meta = lambda a, v: [rf"<meta{gap}{a}={q}{v}{q}{gap}content={q}({inner}){q}", rf"<meta{gap}content={q}({inner}){q}{gap}{a}={q}{v}{q}"]
    field = lambda f, n=1: rf'"{f}"\s*:\s*"([^"]{{{n},}})"'
    text = clean if loose else (lambda t: entities.unescape(t.strip())) if name == "TOI" else str.strip

    def first(patterns, least, after=lambda t: t, read=text):
        for p in patterns:
            if (m := re.search(p, page, re.I)) and len(t := after(read(m[1]))) > least:
                return t

    ends = {"BBC": r"\s*[-|]\s*BBC.*$", "AlJazeera": r"(?i)\s*[-|]\s*Al Jazeera.*$", "NDTV": r"(?i)\s*[-|]\s*NDTV.*$", "India Today": r"(?i)\s*[-|]\s*India Today.*$", "TOI": r"(?i)\s*\|\s*Times of India.*$", "Reuters": r"\s*[-|]\s*Reuters.*$", "Guardian": r"\s*\|\s*.*$", "The Hindu": r"(?i)\s*\|\s*The Hindu.*$"}
    titles = meta("property", "og:title")
    titles = [field("headline"), *titles] if name in ("AlJazeera", "Reuters") else [*titles, field("headline")]
    titles += ["<title>([^<]+)</title>"] + (["<h1[^>]*>([^<]+)</h1>"] if name not in ("TOI", "The Hindu") else [])
    title = first(titles, 12 if name in ("BBC", "AlJazeera") else 15, lambda t: re.sub(ends[name], "", t))
    told_read = text if loose else (lambda t: text(t.strip().replace("\\n", " ").replace("\\u0027", "'")))
    bodies = {"BBC": [("articleBody", 80), ("summary", 80), ("description", 80)], "AlJazeera": [("articleBody", 80), ("description", 80)], "Reuters": [("articleBody", 1), ("description", 50)], "Guardian": [("description", 50)]}
    body = first([field(*b) for b in bodies.get(name, [])], 55 if loose else 100, read=told_read)
    if body is None:
        never = {"BBC": ["copyright", "rights reserved", "javascript", "cookie"], "AlJazeera": ["copyright", "javascript", "cookie", "newsletter"], "NDTV": ["copyright", "advertisement", "read all about"], "India Today": ["copyright", "advertisement", "read more"], "TOI": ["copyright", "subscribe", "advertisement"], "Reuters": ["copyright", "cookie", "javascript", "browser"], "Guardian": ["copyright", "cookie", "javascript"], "The Hindu": []}[name]
        found = re.findall(r"<p\b[^>]*>(.*?)</p>" if loose else r"<p[^>]*>(.*?)</p>", page, re.S | (re.I if loose or name == "TOI" else 0))
        parts = [clean(re.sub("<[^>]+>", " ", p)) if loose else re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]+>", " ", p)).strip()) if name == "TOI" else re.sub("<[^>]+>", "", p).strip() for p in found]
        parts = [p for p in parts if len(p) > {"NDTV": 28, "India Today": 28}.get(name, 24 if loose or name == "TOI" else 50) and not any(n in p.lower() for n in never)]
        joined = " ".join(parts[: 10 if loose or name == "TOI" else 8])
        if len(parts) >= 3 or len(joined) > 260:
            body = joined
        else:
            told = meta("property", "og:description")
            told = (told[:1] if name == "AlJazeera" else told) + meta("name", "description")[:1] + ([field("description", 80 if loose else 70)] if name in ("NDTV", "India Today", "TOI") else [])
            body = first(told, {"BBC": 55, "AlJazeera": 55, "NDTV": 75, "India Today": 75, "TOI": 70}.get(name, 100), read=told_read) or (joined if parts else None)
    stamps = ["<time[^>]+datetime=" + ("[\"']([^\"']+)[\"']" if loose else '"([^"]+)"'), field("datePublished")]
    stamps = stamps if name in ("BBC", "AlJazeera") else stamps[::-1]
    published = next((m[1] for p in stamps if (m := re.search(p, page, re.I if name in ("NDTV", "India Today") else 0))), None)
    og, tw, image, thing = meta("property", "og:image"), meta("name", "twitter:image")[:1], [field("image")], [r'"image"\s*:\s*\{[^}]*"url"\s*:\s*"([^"]+)"']
    ways = {"AlJazeera": thing + image + og[:1] + tw, "Reuters": thing + image + og + tw, "Guardian": og + image + tw, "The Hindu": og}.get(name, og + tw)
    picture = None
    for p in ways:
        if (m := re.search(p, page, re.I)) and picture is None:
            u = entities.unescape(m[1].strip()) if name in ("TOI", "NDTV") else m[1].strip()
            if u.startswith("http") and not (name == "NDTV" and ".svg" in u.lower()):
                picture = u
    if name == "TOI" and picture and (m := re.search(r"/photo/(\d+)\.cms$", picture)):
        picture = f"https://static.toiimg.com/thumb/msid-{m[1]},width-1280,height-720,resizemode-6/photo.jpg"
    return title, body, published, picture


def test_every_publishers_cascade(spark):
    rng = random.Random(12)
    pages = ["", *("\n".join(rng.sample(HEADS, rng.randrange(0, 9)) + [rng.choice(PARTS) for _ in range(rng.choice((0, 1, 2, 4, 12)))]) for _ in range(150))]
    rows = [(k, name, page, "own") for k, page in enumerate(pages) for name in X.CASCADES] + [(-1, "Other", pages[3], "own"), (-2, "BBC", None, "own"), (-3, None, pages[3], "own")]
    table = spark.createDataFrame(rows, "k int, publisher string, html string, title string").repartition(4)
    got = {(r.k, r.publisher): r.article and tuple(r.article) for r in X.extracted(table, F.col("publisher")).collect()}
    assert got.pop((-1, "Other")) is None and got.pop((-3, None)) is None and got.pop((-2, "BBC")) == (None,) * 4
    for (k, name), article in got.items():
        assert article == plain(pages[k], name), (name, pages[k])
    for at in range(4):
        assert 50 < sum(a[at] is not None for a in got.values()) < len(got)
