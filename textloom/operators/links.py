"""Article links of each publisher's listing pages: one table of patterns, one expression a rule. No shuffle."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import desk_lexicons as D
from ..functions import text as X


@dataclass(frozen=True)
class LinkRule:
    """``patterns`` in order, each with one group; ``spare`` is added if they find fewer than ``enough`` links. A link must
    match all of ``must`` (of its whole address) and hold none of ``never`` (of its address in lower case; with ``by_path`` of
    its path alone, and then entities of all kinds are decoded)."""

    base: str
    patterns: tuple[str, ...]
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    spare: str | None = None
    enough: int = 1
    section: str | None = None
    newest_first: bool = False
    by_path: bool = False


# Where publishers' article links stand and how they look.
ANY_HREF = r"""href=["']([^"']+)["']"""
RULES = {
    "bbc": LinkRule(
        "https://www.bbc.com", (r'href="(/news/articles/[^"]+)"', r'href="(/news/[^"]+\-\d+)"', r'href="(https://www\.bbc\.com/news/articles/[^"]+)"'),
        must=(r"^https://www\.bbc\.com/news",), never=("/live/",),
    ),
    "toi": LinkRule(
        "https://timesofindia.indiatimes.com",
        (r'href="(https://timesofindia\.indiatimes\.com/india/[^"]+/articleshow/\d+\.cms)"', r'href="(/india/[^"]+/articleshow/\d+\.cms)"'),
        must=("/articleshow/",), spare=r'href="(https://timesofindia\.indiatimes\.com/[^"]+/articleshow/\d+\.cms)"', enough=3,
    ),
    "ndtv": LinkRule(
        "https://www.ndtv.com", (ANY_HREF,), must=(r"(?i)^https?://(?:www\.|sports\.)?ndtv\.com(?:[/?#]|$)", r"^[^?#]*-\d{5,}"),
        never=("/video", "/videos", "/photos", "/live", "/webstories", "/opinions"), by_path=True,
    ),
    "indiatoday": LinkRule(
        "https://www.indiatoday.in", (ANY_HREF,), must=(r"(?i)^https?://www\.indiatoday\.in(?:[/?#]|$)", r"(?i)^[^?#]*/story/", r"^[^?#]*-\d{5,}"),
        never=("/video", "/videos", "/photos", "/visualstories", "/fact-check"), by_path=True,
    ),
    "reuters": LinkRule(
        "https://www.reuters.com", (r'href="(https://www\.reuters\.com/[^"]+)"', r'href="(/[^"#?]+)"'),
        must=(r"^https://www\.reuters\.com[^?#]*/world/", r"^https://www\.reuters\.com(?:[^?#]*-[A-Z0-9]{6,}/?(?:[?#]|$)|(?:/[^/?#]*){3,}/[^/?#]*-[^/?#]*(?:[?#]|$))"),
        never=("/video/", "/pictures/", "/graphics/", "/podcast/", "/live/"),
    ),
    "aljazeera": LinkRule(
        "https://www.aljazeera.com", (r'href="(/news/\d{4}/\d{1,2}/\d{1,2}/[^"]+)"', r'href="(https://www\.aljazeera\.com/news/\d{4}/\d{1,2}/\d{1,2}/[^"]+)"'),
    ),
    "thehindu": LinkRule(
        "https://www.thehindu.com", (r'href="(https?://(?:www\.)?thehindu\.com/news/national/[^"]+\.ece[^"]*)"',), spare=r'href="(/news/national/[^"]+\.ece[^"]*)"',
    ),
    "guardian": LinkRule(
        "https://www.theguardian.com", (r'href="(https://www\.theguardian\.com/[^"#?]+/\d{4}/[a-z]{3}/\d{1,2}/[^"#?]+)"', r'href="(/[^"#?]+/\d{4}/[a-z]{3}/\d{1,2}/[^"#?]+)"'),
        never=("/live/", "/video/"), section="/world/", newest_first=True,
    ),
}


def _all(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)" + pattern), F.lit(1))


def _absolute(link: Column, base: str) -> Column:
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(F.concat(F.lit(base + "/"), link))
    )


def _date_key(link: Column) -> Column:
    """The day in a dated address as a number, 0 if it has none."""
    shape = r"/(\d{4})/([a-z]{3})/(\d{1,2})/"
    month = F.array_position(F.array(*map(F.lit, D.MONTHS)), F.regexp_extract(link, shape, 2))
    day = F.regexp_extract(link, shape, 1).try_cast("long") * 10000 + month * 100 + F.regexp_extract(link, shape, 3).try_cast("long")
    return F.when(month > 0, day).otherwise(F.lit(0).cast("long"))


def article_links(html: Column, rule: LinkRule, limit: int = 20) -> Column:
    """Distinct absolute links in the rule's order, cut at the limit (a parameter); none for a null page."""
    html = F.coalesce(html, F.lit(""))
    found = F.concat(*(_all(html, p) for p in rule.patterns))
    if rule.spare:
        found = F.when(F.size(found) < rule.enough, F.concat(found, _all(html, rule.spare))).otherwise(found)
    def plain(x: Column) -> Column:
        x = F.trim(x)
        for name, mark in (*(X.ENTITIES[1:] if rule.by_path else ()), X.ENTITIES[0]):
            x = F.replace(x, F.lit(name), F.lit(mark))
        return x

    urls = F.transform(F.transform(found, plain), lambda x: _absolute(x, rule.base))

    def good(u: Column) -> Column:
        out = F.lit(True)
        for pattern in rule.must:
            out = out & u.rlike(pattern)
        seen = F.lower(F.regexp_extract(u, "^[^/?#]*//[^/?#]*([^?#]*)", 1) if rule.by_path else u)
        return out & ~X.any_part(seen, rule.never) if rule.never else out

    urls = F.array_distinct(F.filter(urls, good))
    if rule.section:
        inside = F.filter(urls, lambda u: F.contains(u, F.lit(rule.section)))
        urls = F.when(F.size(inside) >= max(3, min(limit, 6)), inside).otherwise(urls)
    if rule.newest_first:
        dated = F.transform(urls, lambda u, k: F.struct((-_date_key(u)).alias("day"), k.alias("pos"), u.alias("url")))
        urls = F.transform(F.array_sort(dated), lambda d: d["url"])
    return F.slice(urls, 1, limit)


def of_section(name: str, section: str) -> LinkRule:
    """A publisher's rule for the listing page of a section (the first part of its path, 'india' or 'world'; may be empty).
    Publishers whose rules don't depend on sections keep theirs."""
    rule, part = RULES[name], re.escape(section.strip("/").split("/")[0])
    if name == "toi":
        part = part or "india"
        return replace(rule, patterns=(rf'href="(https://timesofindia\.indiatimes\.com/{part}/[^"]+/articleshow/\d+\.cms)"', rf'href="(/{part}/[^"]+/articleshow/\d+\.cms)"'))
    if name == "reuters":
        # an address that is no more than a section has a closing slash and two slashes at most
        inside = rf"^https://www\.reuters\.com[^?#]*/{part}/" if part else r"^https://www\.reuters\.com(?:[^?#]*[^/?#]|(?:/[^/?#]*){3,})(?:[?#]|$)"
        return replace(rule, must=(inside, *rule.must[1:]))
    if name == "guardian":
        return replace(rule, section=f"/{section.strip('/').split('/')[0]}/" if part else None)
    return rule


def by_publisher(pages: DataFrame, limit: int = 20, rules: dict[str, LinkRule] = RULES) -> DataFrame:
    """page_id, publisher, pos (from 1), link: every rule on every page. Expects page_id and html."""
    lists = F.array(*(F.struct(F.lit(name).alias("publisher"), article_links(F.col("html"), rule, limit).alias("links")) for name, rule in rules.items()))
    rows = pages.select("page_id", F.inline(lists))
    return rows.select("page_id", "publisher", F.posexplode("links").alias("pos", "link")).withColumn("pos", F.col("pos") + 1)


def long_enough(title: Column, body: Column, source: Column, preview: Column) -> Column:
    """An extracted article of a known source that isn't too short for it and has a preview picture where one is needed."""
    out = F.lit(False)
    for name, (t, b, picture) in D.LEAST.items():
        fits = (F.length(F.coalesce(title, F.lit(""))) >= t) & (F.length(F.coalesce(body, F.lit(""))) >= b)
        out = F.when(source == name, fits & (F.coalesce(preview, F.lit("")) != "") if picture else fits).otherwise(out)
    return out


# Where the time of publication and the preview picture stand, best first.
TIME_PATTERNS = (r'(?i)"datePublished"\s*:\s*"([^"]+)"', r"""(?i)<time[^>]+datetime=["']([^"']+)["']""")
PICTURE_PATTERNS = (
    r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']""", r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image["']""",
    r"""(?i)<meta[^>]+name=["']twitter:image["'][^>]+content=["']([^"']+)["']""", r'(?i)"image"\s*:\s*"(https?://[^"]+)"',
)


def _first(html: Column, patterns: tuple[str, ...]) -> list[Column]:
    return [F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), p, 1)) for p in patterns]


def published_time(html: Column) -> Column:
    """The page's own time of publication as text; null if it states none."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in _first(html, TIME_PATTERNS)))


def preview_picture(html: Column) -> Column:
    """The address of the preview picture; only http, no drawings; null if there is none."""
    return F.coalesce(*(F.when(F.lower(u).startswith("http") & ~F.lower(u).endswith(".svg"), u) for u in _first(html, PICTURE_PATTERNS)))
