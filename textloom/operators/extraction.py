"""Articles of each publisher's pages: title, body, time and preview picture by cascades, as tables of patterns.

A cascade takes the first pattern whose text is long enough. All is column expressions over one page, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _tag(loose: bool, attribute: str, value: str, turned: bool = False) -> str:
    """The content of a meta tag; ``turned`` if content comes first. Loose tags may hold more and have either quotes."""
    q, gap, inside = ("[\"']", "[^>]+", "[^\"']+") if loose else ('"', r"\s+", '[^"]+')
    name, content = f"{attribute}={q}{value}{q}", f"content={q}({inside}){q}"
    between = gap if loose else r"\s+"
    return rf"<meta{gap}{content}{between}{name}" if turned else rf"<meta{gap}{name}{between}{content}"


def _json(field: str, least: int = 1) -> str:
    return rf'"{field}"\s*:\s*"([^"]{{{least},}})"' if least > 1 else rf'"{field}"\s*:\s*"([^"]+)"'


_PAGE_TITLE, _H1, _IMAGE = r"<title>([^<]+)</title>", r"<h1[^>]*>([^<]+)</h1>", r'"image"\s*:\s*\{[^}]*"url"\s*:\s*"([^"]+)"'


@dataclass(frozen=True)
class Cascade:
    """How a publisher's pages are read.

    loose: tags in any form; times_case: the flags that times are looked for with; clean: 'full' (entities, escapes, spaces), 'entities', or 'plain'. titles without ``suffix``
    (a pattern) and over ``title_least``; bodies: patterns of whole bodies in JSON over ``body_least``; paragraphs over
    ``part_least`` without ``never``, ``parts`` of them, if there are three or 260 characters; else descriptions over
    ``told_least``; else the paragraphs that there are."""

    loose: bool
    clean: str
    titles: tuple[str, ...]
    suffix: str
    title_least: int
    bodies: tuple[str, ...]
    body_least: int
    part_least: int
    never: tuple[str, ...]
    parts: int
    told: tuple[str, ...]
    told_least: int
    times: tuple[str, ...]
    pictures: tuple[str, ...]
    no_svg: bool = False
    times_case: str = ""


def _cascade(loose: bool, clean: str, suffix: str, title_least: int, bodies, body_least: int, part_least: int, never, parts: int, told_least: int, json_told: int = 0,
             headline_first: bool = False, h1: bool = True, turned_told: bool = True, time_first: bool = False, pictures: str = "og turned tw", no_svg: bool = False, times_case: str = "") -> Cascade:
    og = (_tag(loose, "property", "og:title"), _tag(loose, "property", "og:title", True))
    titles = ((_json("headline"), *og) if headline_first else (*og, _json("headline"))) + (_PAGE_TITLE,) + ((_H1,) if h1 else ())
    told = (_tag(loose, "property", "og:description"), *((_tag(loose, "property", "og:description", True),) if turned_told else ()), _tag(loose, "name", "description"), *((_json("description", json_told),) if json_told else ()))
    stamp = r"<time[^>]+datetime=" + ("[\"']([^\"']+)[\"']" if loose else '"([^"]+)"')
    times = (stamp, _json("datePublished")) if time_first else (_json("datePublished"), stamp)
    ways = {"og": _tag(loose, "property", "og:image"), "turned": _tag(loose, "property", "og:image", True), "tw": _tag(loose, "name", "twitter:image"), "image": _json("image"), "object": _IMAGE}
    return Cascade(loose, clean, titles, suffix, title_least, tuple(bodies), body_least, part_least, tuple(never), parts, told, told_least, times, tuple(ways[p] for p in pictures.split()), no_svg, times_case)


# The publishers' cascades.
CASCADES = {
    "BBC": _cascade(True, "full", r"\s*[-|]\s*BBC.*$", 12, (_json("articleBody", 80), _json("summary", 80), _json("description", 80)), 55, 24, ("copyright", "rights reserved", "javascript", "cookie"), 10, 55, time_first=True),
    "AlJazeera": _cascade(True, "full", r"(?i)\s*[-|]\s*Al Jazeera.*$", 12, (_json("articleBody", 80), _json("description", 80)), 55, 24, ("copyright", "javascript", "cookie", "newsletter"), 10, 55, headline_first=True, turned_told=False, time_first=True, pictures="object image og tw"),
    "NDTV": _cascade(True, "full", r"(?i)\s*[-|]\s*NDTV.*$", 15, (), 0, 28, ("copyright", "advertisement", "read all about"), 10, 75, json_told=80, no_svg=True, times_case="(?i)"),
    "India Today": _cascade(True, "full", r"(?i)\s*[-|]\s*India Today.*$", 15, (), 0, 28, ("copyright", "advertisement", "read more"), 10, 75, json_told=80, times_case="(?i)"),
    "TOI": _cascade(False, "entities", r"(?i)\s*\|\s*Times of India.*$", 15, (), 0, 24, ("copyright", "subscribe", "advertisement"), 10, 70, json_told=70, h1=False),
    "Reuters": _cascade(False, "plain", r"\s*[-|]\s*Reuters.*$", 15, (_json("articleBody"), _json("description", 50)), 100, 50, ("copyright", "cookie", "javascript", "browser"), 8, 100, headline_first=True, pictures="object image og turned tw"),
    "Guardian": _cascade(False, "plain", r"\s*\|\s*.*$", 15, (_json("description", 50),), 100, 50, ("copyright", "cookie", "javascript"), 8, 100, pictures="og turned image tw"),
    "The Hindu": _cascade(False, "plain", r"(?i)\s*\|\s*The Hindu.*$", 15, (), 0, 50, (), 8, 100, h1=False, pictures="og turned"),
}


def _cleaned(c: Column, how: str) -> Column:
    if how == "full":
        return X.clean_html_text(c)
    if how == "entities":
        for name, mark in (*X.ENTITIES[1:], X.ENTITIES[0]):
            c = F.replace(c, F.lit(name), F.lit(mark))
    return F.btrim(c, F.lit(" \t\r\n\f"))


def _told_text(c: Column, how: str) -> Column:
    return _cleaned(F.replace(F.replace(F.btrim(c, F.lit(" \t\r\n\f")), F.lit("\\n"), F.lit(" ")), F.lit("\\u0027"), F.lit("'")), how)


def _found(html: Column, pattern: str, flags: str = "(?i)") -> Column:
    """The first match's group; null if there is none."""
    return F.nullif(F.regexp_extract(html, flags + pattern, 1), F.lit(""))


def _first_over(found: list[Column], least: int) -> Column:
    return F.coalesce(*(X.let(c, lambda t: F.when(F.length(t) > least, t)) for c in found), F.lit(None).cast("string"))


def title(html: Column, c: Cascade) -> Column:
    return _first_over([F.regexp_replace(_cleaned(_found(html, p), c.clean), c.suffix, "") for p in c.titles], c.title_least)


def paragraphs(html: Column, c: Cascade) -> Column:
    flags = "(?is)" if c.loose or c.clean == "entities" else "(?s)"
    raw = F.regexp_extract_all(html, F.lit(flags + (r"<p\b[^>]*>(.*?)</p>" if c.loose else "<p[^>]*>(.*?)</p>")), F.lit(1))
    texts = F.transform(raw, lambda p: _cleaned(F.regexp_replace(p, "<[^>]+>", "" if c.clean == "plain" else " "), c.clean))
    texts = F.transform(texts, lambda t: X.collapse(t)) if c.clean == "entities" else texts
    good = lambda t: (F.length(t) > c.part_least) & (~X.any_part(F.lower(t), c.never) if c.never else F.lit(True))
    return F.filter(texts, good)


def body(html: Column, c: Cascade) -> Column:
    whole = _first_over([_told_text(_found(html, p), c.clean) for p in c.bodies], c.body_least) if c.bodies else F.lit(None).cast("string")
    told = _first_over([_told_text(_found(html, p), c.clean) for p in c.told], c.told_least)

    def of_parts(parts: Column) -> Column:
        text = F.array_join(F.slice(parts, 1, c.parts), " ")
        return F.when((F.size(parts) >= 3) | (F.length(text) > 260), text).otherwise(F.coalesce(told, F.when(F.size(parts) > 0, text)))

    return F.coalesce(whole, X.let(paragraphs(html, c), of_parts))


def published(html: Column, c: Cascade) -> Column:
    return F.coalesce(*(_found(html, p, c.times_case) for p in c.times))


def picture(html: Column, c: Cascade) -> Column:
    """The first preview picture with a whole address; photo pages of one publisher become their picture."""
    def good(u: Column) -> Column:
        u = F.btrim(u) if c.clean != "entities" and not c.no_svg else _cleaned(u, "entities")
        return X.let(u, lambda x: F.when(x.startswith("http") & (~F.lower(x).contains(".svg") if c.no_svg else F.lit(True)), x))

    found = F.coalesce(*(good(_found(html, p)) for p in c.pictures))
    number = F.regexp_extract(found, r"(?i)/photo/(\d+)\.cms", 1)
    photo = found.endswith(".cms") & (number != "")
    return F.when(photo, F.concat(F.lit("https://static.toiimg.com/thumb/msid-"), number, F.lit(",width-1280,height-720,resizemode-6/photo.jpg"))).otherwise(found) if c.clean == "entities" else found


def extracted(pages: DataFrame, publisher: Column, html: str = "html") -> DataFrame:
    """Adds `article`: a struct (title, body, published, picture) read by the cascade of the row's publisher; null for other
    publishers. What isn't found is null; a null page is an empty one."""
    page, out = F.coalesce(F.col(html), F.lit("")), F.lit(None)
    for name, c in CASCADES.items():
        read = F.struct(title(page, c).alias("title"), body(page, c).alias("body"), published(page, c).alias("published"), picture(page, c).alias("picture"))
        out = F.when(publisher == name, read) if out is None else F.when(publisher == name, read).otherwise(out)
    return pages.withColumn("article", out)
