"""Picture candidates of an article's page: where its addresses stand, in what order they are tried, and other addresses of
the same picture. One expression a page, no shuffle; a null page or address has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import desk_lexicons as D
from ..functions import text as X

_KIND = "array<struct<url:string,place:string,priority:int,width:int,context:string>>"
_TOI, _TODAY = "timesofindia.indiatimes.com", "indiatoday.in"

# Addresses of two publishers' own pictures, what in them is no news picture, and words that tell no story.
TOI_PICTURE, TODAY_PICTURE = r'https://static\.toiimg\.com/[^"\s]+', r'https://akm-img-a-in\.tosshub\.com/indiatoday/images/story/[^"\s]+\.(?:jpg|jpeg|png|webp)(?:\?[^"\s]+)?'
TOI_NEVER = ("ai-generated-image", "representational-purpose", "used-only-for-representational-purpose")
TODAY_NEVER = ("/reporter/", "androidtv-app", "default-690x413", "screenshot_", "/sites/indiatoday/resources/")
SLUG_STOPWORDS = (
    "story", "india", "today", "world", "news", "video", "photos", "latest", "middle", "east", "update", "updates", "live", "breaking", "review", "watch",
    "explained", "report", "reports",
)
SMALLEST, SCHEMA_MOST, BODY_MOST, CONTEXT = 220, 6, 24, 180


def candidate_url(c: Column) -> Column:
    """An address as it is asked for: entities decoded, spaces escaped."""
    c = F.trim(F.coalesce(c, F.lit("")))
    for name, mark in (*X.ENTITIES[1:], X.ENTITIES[0]):
        c = F.replace(c, F.lit(name), F.lit(mark))
    return F.replace(c, F.lit(" "), F.lit("%20"))


def joined(base: Column, link: Column) -> Column:
    """A link of a page as an absolute address; dots in relative paths stay."""
    root, scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link == "", base).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), link)).otherwise(F.concat(folder, link))
    )


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def _entry(url: Column, place: str, priority: Column | int, width: Column | int = 0, context: Column | str = "") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(url.alias("url"), F.lit(place).alias("place"), lit(priority).cast("int").alias("priority"), lit(width).cast("int").alias("width"), lit(context).alias("context"))


def _meta(html: Column, attribute: str, value: str) -> Column:
    """The content of a meta tag, its attributes in either order; null if there is none."""
    q = r"""["']"""
    ways = (rf"(?i)<meta[^>]+{attribute}={q}{value}{q}[^>]+content={q}([^\"']+){q}", rf"(?i)<meta[^>]+content={q}([^\"']+){q}[^>]+{attribute}={q}{value}{q}")
    return F.coalesce(*(F.try_element_at(_all(html, p), F.lit(1)) for p in ways))


def _attribute(tag: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*["']([^"']+)["']""", 1))


def widest(srcset: Column) -> Column:
    """url and width of the widest picture of a srcset, the first of equals; null where no width is given."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.trim(p)), lambda p: p != "")
    sized = F.transform(parts, lambda p, k: F.struct(F.coalesce(F.regexp_extract(p, r"^\S+\s+([0-9]+)w(?:\s|$)", 1).try_cast("int"), F.lit(0)).alias("width"), (-k).alias("order"), F.split(p, r"\s+")[0].alias("url")))
    best = F.array_max(sized)
    return F.when(best["width"] > 0, best)


def _body(html: Column, base: Column) -> Column:
    def read(tag: Column) -> Column:
        late = _attribute(tag, "data-src")
        context = F.lower(F.trim(F.concat_ws(" ", _attribute(tag, "alt"), _attribute(tag, "title"), _attribute(tag, "class"))))
        width = F.coalesce(F.regexp_extract(_attribute(tag, "width"), "([0-9]+)", 1).try_cast("int"), F.lit(0))
        return F.struct(F.when(late != "", late).otherwise(_attribute(tag, "src")).alias("src"), context.alias("context"), width.alias("width"))

    def good(x: Column) -> Column:
        return (x["src"] != "") & ~x["src"].startswith("data:") & ~X.any_part(x["context"], D.UNWANTED) & ((x["width"] == 0) | (x["width"] >= SMALLEST))

    found = F.slice(F.filter(F.transform(_all(html, r"(?i)<img\b[^>]*>", 0), read), good), 1, BODY_MOST)
    return F.transform(found, lambda x: _entry(candidate_url(joined(base, x["src"])), "body", 5, x["width"], F.left(x["context"], F.lit(CONTEXT))))


def _slug_words(base: Column) -> Column:
    """What the last part of an article's address tells of it."""
    slug = F.regexp_extract(F.lower(base), r"^[^?#]*?//[^/?#]*[^?#]*?([^/?#]*)/*(?:[?#]|$)", 1)
    for pattern in (r"articleshow/\d+\.cms$", r"-\d{4}-\d{2}-\d{2}$", r"-\d+$"):
        slug = F.regexp_replace(slug, pattern, "")
    return F.filter(_all(slug, "[a-z]{4,}", 0), lambda w: ~w.isin(*SLUG_STOPWORDS))


def _shared(url: Column, words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(F.lower(url), w)))


def _own(html: Column, base: Column, host: Column, article: Column, words: Column) -> Column:
    """Pictures that two publishers' pages hold outside their tags, for their own pages alone."""
    once = lambda pattern: F.array_distinct(F.transform(_all(html, f"(?i){pattern}", 0), candidate_url))
    of_article = lambda u: (article == "") | F.contains(F.lower(u), F.concat(F.lit("msid-"), article)) | F.contains(F.lower(u), F.concat(F.lit("/"), article, F.lit(".jpg")))
    first = lambda u: F.when((article != "") & F.contains(F.lower(u), F.concat(F.lit("msid-"), article)), 1).otherwise(2)
    toi = F.transform(F.filter(once(TOI_PICTURE), lambda u: of_article(u) & ~X.any_part(F.lower(u), TOI_NEVER)), lambda u: _entry(u, "source:toi", first(u), 0, "toi hero"))
    fits = lambda u: ~X.any_part(F.lower(u), TODAY_NEVER) & ((F.size(words) == 0) | (_shared(u, words) >= 2))
    today = F.transform(F.filter(once(TODAY_PICTURE), fits), lambda u: _entry(u, "source:indiatoday", F.when(F.lower(u).contains("16x9_0"), 1).otherwise(2), 0, "indiatoday hero"))
    return F.when(host.contains(_TOI), toi).when(host.contains(_TODAY), today).otherwise(F.array().cast(_KIND))


def candidates(html: Column, base: Column) -> Column:
    """Structs (url, place, priority, width, context) in the order in which they are tried: by priority, wider first, then
    as the page has them.

    Places: the publisher's own, og:image, twitter:image, schema, srcset, body. On two publishers' pages their pictures of
    other articles go, unless nothing would be left."""
    html, base = F.coalesce(html, F.lit("")), F.coalesce(base, F.lit(""))
    host, article = F.lower(F.regexp_extract(base, "^[^?#]*?//([^/?#]*)", 1)), F.regexp_extract(base, r"(?i)articleshow/(\d+)\.cms", 1)
    words = _slug_words(base)
    at = lambda link: candidate_url(joined(base, link))
    single = lambda link, place, priority: F.when(link.isNotNull(), F.array(_entry(at(link), place, priority))).otherwise(F.array().cast(_KIND))
    schema = F.slice(F.concat(_all(html, r'"image"\s*:\s*"([^"]+)"'), _all(html, r'"image"\s*:\s*\{[^\}]*"url"\s*:\s*"([^"]+)"')), 1, SCHEMA_MOST)
    sets = F.filter(F.transform(_all(html, r"""(?i)srcset=["']([^"']+)["']"""), widest), lambda x: x.isNotNull())
    found = F.concat(
        _own(html, base, host, article, words), single(_meta(html, "property", "og:image"), "og:image", 1), single(_meta(html, "name", "twitter:image"), "twitter:image", 2),
        F.transform(schema, lambda u: _entry(at(u), "schema", 3)), F.transform(sets, lambda x: _entry(at(x["url"]), "srcset", 4, x["width"], "srcset")), _body(html, base),
    )

    def own_alone(x: Column) -> Column:
        low = F.lower(x["url"])
        of_article = F.contains(low, F.concat(F.lit("msid-"), article)) | F.contains(low, F.concat(F.lit("/"), article, F.lit(".jpg"))) | F.contains(low, F.concat(F.lit("/"), article, F.lit(".jpeg")))
        toi = ~host.contains(_TOI) | (article == "") | ~low.contains("static.toiimg.com") | of_article
        return toi & (~host.contains(_TODAY) | (F.size(words) == 0) | ~low.contains("akm-img-a-in.tosshub.com/indiatoday/images/story/") | (_shared(low, words) >= 2))

    def ordered(x: Column) -> Column:
        keyed = F.transform(x, lambda c, k: F.struct(c["priority"].alias("p"), (-c["width"]).alias("w"), k.alias("k"), c.alias("c")))
        return F.transform(F.array_sort(keyed), lambda s: s["c"])

    kept = X.let(F.filter(found, lambda x: x["url"] != ""), lambda all_: X.let(F.filter(all_, own_alone), lambda some: F.when(F.size(some) > 0, some).otherwise(all_)))
    return F.when(html == "", F.array().cast(_KIND)).otherwise(X.let(kept, ordered))


def distinct(found: Column) -> Column:
    """The candidates without those whose address, but for its query and case, came before."""
    keys = lambda x: F.transform(x, lambda c: F.lower(F.split(c["url"], r"\?")[0]))
    return X.let(found, lambda x: X.let(keys(x), lambda k: F.filter(x, lambda c, i: F.array_position(k, F.get(k, i)) == i + 1)))


def download_urls(url: Column) -> Column:
    """Addresses at which a picture may be had, best first: larger ones that two publishers offer, its own, without asked
    overlays, without its query, without overlays in its path."""
    def ways(u: Column) -> Column:
        host, path, query = F.lower(F.regexp_extract(u, "^[^?#]*?//([^/?#]*)", 1)), F.regexp_extract(u, "^([^?#]*)", 1), F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
        number = F.regexp_extract(path, r"(?i)/photo/(\d+)\.cms$", 1)
        toi, guardian = host.contains("static.toiimg.com"), host.contains("i.guim.co.uk")
        thumb = lambda w, h: F.when(toi & (number != ""), F.concat(F.lit("https://static.toiimg.com/thumb/msid-"), number, F.lit(f",width-{w},height-{h},resizemode-6/photo.jpg")))
        sized = lambda w: F.when(guardian, F.concat(path, F.lit(f"?width={w}&dpr=1&s=none&crop=none")))
        pairs = F.filter(F.split(query, "&"), lambda p: p != "")
        unwanted = lambda p: X.any_part(F.lower(F.split(p, "=")[0]), D.BLOCKED_KEYS) | X.any_part(F.lower(F.regexp_extract(p, "=(.*)$", 1)), D.BLOCKED_VALUES)
        clean = F.filter(pairs, lambda p: ~unwanted(p))
        asked = lambda p, q: F.when(F.size(q) > 0, F.concat(p, F.lit("?"), F.array_join(q, "&"))).otherwise(p)
        bare = F.when(toi, F.regexp_replace(F.regexp_replace(path, "(?i),overlay-[^,/]+", ""), r"(?i),(?:pt|x_pad|y_pad)-\d+", "")).otherwise(path)
        other = lambda c: F.when(bare != path, c)
        return F.array_distinct(F.array_compact(F.array(
            thumb(1600, 900), thumb(1280, 720), sized(1600), sized(1200), u, F.when(F.size(clean) < F.size(pairs), asked(path, clean)), F.when(query != "", path),
            other(asked(bare, pairs)), other(F.when(F.size(clean) > 0, asked(bare, clean))), other(bare),
        )))

    return X.let(candidate_url(url), lambda u: F.when(u == "", F.array().cast("array<string>")).otherwise(ways(u)))


def of_pages(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """Adds `pictures`: a page's distinct candidates in order."""
    return pages.withColumn("pictures", distinct(candidates(F.col(html), F.col(base))))
