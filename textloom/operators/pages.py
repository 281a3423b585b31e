"""Raw pages: links, titles, bodies, by patterns of the JVM's regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Where a title stands, best first.
TITLE_PATTERNS = (
    r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:title["']""",
    r"""(?i)"headline"\s*:\s*"([^"]+)\"""",
    r"(?i)<title>([^<]+)</title>",
    r"(?i)<h1[^>]*>([^<]+)</h1>",
)
# Paragraphs with these words aren't body text.
NOT_BODY = ("copyright", "rights reserved", "javascript", "cookie")


def title(html: Column, least: int = 12) -> Column:
    """The first long enough title of the cascade."""
    return X.first_long([X.clean_html_text(F.regexp_extract(html, p, 1)) for p in TITLE_PATTERNS], least)


def paragraphs(html: Column, least: int = 24) -> Column:
    """Texts of the paragraphs that are long enough and no boilerplate, in order."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    texts = F.transform(raw, lambda p: X.clean_html_text(F.regexp_replace(p, "<[^>]+>", " ")))
    return F.filter(texts, lambda t: (F.length(t) > least) & ~X.any_part(F.lower(t), NOT_BODY))


def body(html: Column, first: int = 10) -> Column:
    """The first paragraphs, joined; null if there are none."""
    found = paragraphs(html)
    return F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, first), " "))


def links(pages: DataFrame, limit: int = 20) -> DataFrame:
    """page_id, pos, link: distinct links of a page in the order first met, cut at the limit (a parameter)."""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "href"))
    base = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    rows = rows.withColumn("link", F.when(F.col("href").startswith("/"), F.concat(base, "href")).otherwise(F.col("href")))
    first = rows.groupBy("page_id", "link").agg(F.min("pos").alias("first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("first"))).where(F.col("pos") <= limit).select("page_id", "pos", "link")
