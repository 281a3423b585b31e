"""Text expressions: normalising, tokens, sentences, keywords, keys. Columns in, columns out; no Python runs on rows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it: long chains of rules would otherwise
    repeat each other's text."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(c: Column | str) -> Column:
    """White space runs to one space, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))


def normalise(c: Column | str) -> Column:
    """Lower case, ASCII letters and digits alone, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def words(c: Column | str) -> Column:
    """The words of normalised text; none for empty text."""
    return F.filter(F.split(col(c), " "), lambda w: w != "")


def _synonym(token: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in L.SYNONYMS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, token), token)


def _cut(token: Column, n: int) -> Column:
    return F.left(token, F.length(token) - n)


def _ending(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when(token.endswith("ies") & (n > 5), F.concat(_cut(token, 3), F.lit("y")))
        .when(token.endswith("ing") & (n > 6), _cut(token, 3))
        .when(token.endswith("ed") & (n > 5), _cut(token, 2))
        .when(token.endswith("es") & (n > 5), _cut(token, 2))
        .when(token.endswith("s") & (n > 4), _cut(token, 1))
        .otherwise(token)
    )


def canonical(tokens: Column) -> Column:
    """The words' stand-ins: synonym, then one ending off, then synonym again. A step a transform, so that each word's
    value is worked out once a step."""
    return F.transform(F.transform(F.transform(tokens, _synonym), _ending), _synonym)


def _topical(token: Column) -> Column:
    return (F.length(token) >= 3) & ~token.isin(*L.STOPWORDS, *L.GENERIC)


def salient(c: Column | str) -> Column:
    """Canonical topical words in order, repeats kept."""
    return F.filter(canonical(words(normalise(c))), _topical)


def bigrams(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, lambda t, k: F.when(F.get(tokens, k + 1).isNotNull(), F.concat(t, F.lit(" "), F.get(tokens, k + 1)))), lambda b: b.isNotNull())


def sentences(c: Column | str) -> Column:
    """Sentences of collapsed text: a break follows . ! or ?"""
    return F.filter(F.split(collapse(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def lead(c: Column | str, n: int = 2, chars: int = 320) -> Column:
    """The first sentences, cut."""
    return F.left(F.array_join(F.slice(sentences(c), 1, n), " "), F.lit(chars))


def numbers(c: Column | str) -> Column:
    """Distinct whole numbers of normalised text."""
    return F.array_distinct(F.regexp_extract_all(normalise(c), F.lit(r"\b\d+\b"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two sets (arrays without repeats); 0 if either is empty."""
    common = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common)


def hashed(tokens: Column) -> Column:
    """A 64-bit hash of each token."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def numbers_fit(a: Column, b: Column) -> Column:
    """Two sets of numbers agree if one is empty or they share one."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def entities(c: Column | str) -> Column:
    """Distinct canonical words with a capital, in order."""
    raw = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\b[A-Z][A-Za-z0-9'-]{2,}\b"), F.lit(0))
    return F.array_distinct(F.filter(canonical(F.transform(raw, F.lower)), _topical))


def token_set(text: Column) -> Column:
    """The distinct words of a text, as word bounds part them. Keywords looked up in it don't scan the text again."""
    return F.array_distinct(F.split(text, r"[^\p{L}\p{Nd}_]+"))


def _single(keywords: Iterable[str]) -> tuple[list[str], list[str]]:
    keywords = list(dict.fromkeys(keywords))
    return [k for k in keywords if " " not in k], [k for k in keywords if " " in k]


def has_keyword(text: Column, keyword: str, tokens: Column | None = None) -> Column:
    """A phrase anywhere, a single word at word bounds; text is in lower case."""
    k = keyword.strip().lower()
    if not k:
        return F.lit(False)
    if tokens is not None and k.isalnum():
        return F.array_contains(tokens, k)
    return text.contains(k) if " " in k else text.rlike(rf"\b{re.escape(k)}\b")


def keyword_count(text: Column, keywords: Iterable[str], tokens: Column | None = None) -> Column:
    """How many of the keywords a text has. One pass finds the words, none with ``tokens`` (of ``token_set``); phrases are
    looked up each."""
    single, phrases = _single(keywords)
    if single and tokens is not None and all(map(str.isalnum, single)):
        found = F.size(F.array_intersect(tokens, F.array(*map(F.lit, single))))
    else:
        found = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(" + "|".join(map(re.escape, single)) + r")\b"), F.lit(1)))) if single else F.lit(0)
    return sum((text.contains(p).cast("int") for p in phrases), found)


def any_keyword(text: Column, keywords: Iterable[str], tokens: Column | None = None) -> Column:
    single, phrases = _single(keywords)
    hits = [text.contains(k) for k in phrases]
    if single and tokens is not None and all(map(str.isalnum, single)):
        hits.append(F.arrays_overlap(tokens, F.array(*map(F.lit, single))))
    elif single:
        hits.append(text.rlike(rf"\b(?:{'|'.join(map(re.escape, single))})\b"))
    return _any(hits)


def any_part(text: Column, parts: Iterable[str]) -> Column:
    """Whether a text has any of the parts. One that has another part in it needn't be looked for."""
    parts = list(dict.fromkeys(parts))
    return _any([text.contains(p) for p in parts if not any(q in p for q in parts if q != p)])


def _any(hits: list[Column]) -> Column:
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def exploded(rows: DataFrame, array: Column | str, *names: str, keep: str | tuple[str, ...] = "article_id") -> DataFrame:
    """A row for each element: the columns ``keep``, then the element or its place and itself, as ``names`` says. An inner explode makes
    Spark ask first whether the array is empty, and so work out all that makes it a second time; the outer one doesn't."""
    explode = F.posexplode_outer if len(names) == 2 else F.explode_outer
    return rows.select(*([keep] if isinstance(keep, str) else keep), explode(array).alias(*names)).where(F.col(names[0]).isNotNull())


def story_key(title: Column, lead_text: Column) -> Column:
    """A key that retellings of one story share: entities, else topical words of title and lead, and numbers."""
    picked = F.slice(F.array_sort(F.array_distinct(entities(title))), 1, 8)
    of_title = F.array_sort(F.array_distinct(F.filter(salient(title), lambda t: ~t.isin(*L.KEY_GENERIC))))
    of_lead = F.array_sort(F.array_distinct(salient(lead_text)))
    picked = F.when(F.size(picked) < 3, F.slice(F.array_union(picked, of_title), 1, 10)).otherwise(picked)
    picked = F.when(F.size(picked) < 4, F.slice(F.array_union(picked, of_lead), 1, 12)).otherwise(picked)
    picked = F.array_union(picked, F.array_sort(numbers(F.concat_ws(" ", title, lead_text))))
    return F.left(F.sha1(F.when(F.size(picked) == 0, normalise(title)).otherwise(F.array_join(picked, "|"))), F.lit(16))


def stem(word: Column) -> Column:
    """One ending off a word of more than four letters."""
    out = F.when(F.length(word) <= 4, word)
    for suffix, other in L.STEM_SUFFIXES:
        out = out.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= 3), F.concat(_cut(word, len(suffix)), F.lit(other)))
    return out.otherwise(word)


def title_words(c: Column | str) -> Column:
    raw = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(raw, lambda w: ~w.isin(*L.TITLE_STOPWORDS)), stem))


def title_names(c: Column | str) -> Column:
    raw = F.transform(F.split(collapse(c), " "), lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", ""))
    return F.array_distinct(F.transform(F.filter(raw, lambda w: (F.length(w) >= 2) & w.rlike("^[A-Z]") & ~F.lower(w).isin(*L.TITLE_STOPWORDS)), F.lower))


def hashtags(category: Column, title: Column, breaking: Column) -> Column:
    low = F.lower(F.trim(category))
    first = F.when(breaking & ~low.isin("sports", "entertainment"), F.lit("#breaking")).when(low == "sports", F.lit("#trending"))
    tag = F.regexp_replace(low, r"\s+", "")
    found = F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-zA-Z]{4,}"), F.lit(0)), lambda w: ~w.isin(*L.TITLE_STOPWORDS))
    tags = F.concat(F.array(first, F.when(tag != "", F.concat(F.lit("#"), tag))), F.transform(F.slice(F.array_distinct(found), 1, 3), lambda w: F.concat(F.lit("#"), w)))
    return F.left(F.array_join(F.array_distinct(F.array_compact(tags)), " "), F.lit(120))


def normalise_url(c: Column | str) -> Column:
    """Scheme and host in lower case, query and fragment off, closing slashes off; anything else as it is, trimmed."""
    raw = F.trim(F.coalesce(col(c), F.lit("")))
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?[^#]*)?(?:#.*)?$"
    path = F.regexp_replace(F.regexp_extract(raw, shape, 3), ";[^/]*$", "")
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(raw.rlike(shape), F.concat(F.lower(F.regexp_extract(raw, shape, 1)), F.lit("://"), F.lower(F.regexp_extract(raw, shape, 2)), path)).otherwise(raw)


# Entities that titles and paragraphs hold.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"))


def clean_html_text(c: Column) -> Column:
    """Entities, escaped breaks and quotes decoded, white space collapsed."""
    for name, mark in (*ENTITIES[1:], ENTITIES[0], ("\\n", " "), ("\\u0027", "'"), ('\\"', '"')):
        c = F.replace(c, F.lit(name), F.lit(mark))
    return collapse(c)


def first_long(candidates: list[Column], least: int) -> Column:
    """The first candidate of more than ``least`` characters."""
    return F.coalesce(*(F.when(F.length(c) > least, c) for c in candidates))


def share_in_range(c: Column, first: str, last: str) -> Column:
    """Percent of a text's characters, spaces aside, in a range of code points."""
    solid = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    inside = F.length(F.regexp_replace(solid, rf"[^{first}-{last}]", ""))
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise(100.0 * inside / F.length(solid))
