"""Article prose: cleaned bodies, sentence and lede scores, closing sentences, query terms. Nulls count as empty texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import desk_lexicons as D
from ..functions import lexicons as L
from ..functions import text as X


def _text(c: Column | str) -> Column:
    return F.coalesce(X.col(c), F.lit(""))


# Of each rule on closing lines (in small letters) and scripts parts that it can't match without one of: most texts have none.
_TAIL_PARTS = (
    ("-ends", "- ends"), ("published by",), ("published on",), ("also read",), ("story continues below this ad",), ("advertisement",), ("read more at toi",), ("forthcoming stories",),
    ("subscribe to india today",), ("get latest news on",), ("watch live", "watch us on", "follow live", "follow us on"),
)
_SCRIPT_PARTS = (
    ("<",), ("<",), ("(function",), (".createElement", ".appendChild", ".getElementById", ".setAttribute"), ("window.", "document.", "d.head.", "v.location."), ("//",),
)


def clean_body(body: Column, most: int = 5200) -> Column:
    """Prose alone: closing lines, scripts and tags go; cut at ``most`` characters, which is the form of a card's source."""
    def ruled(text: Column, seen: Column, rules, flags: str, apply) -> Column:
        rule = lambda pattern, parts: lambda x: F.when(X.any_part(seen, parts), apply(x, flags + pattern)).otherwise(x)
        for pattern, parts in rules:
            text = X.let(text, rule(pattern, parts))
        return text

    def ended(text: Column) -> Column:
        # a rule takes off the end, so what is left has no part that wasn't there before
        def told(low: Column) -> Column:
            return ruled(text, low, zip(D.TAILS, _TAIL_PARTS, strict=True), "(?is)", lambda x, p: F.trim(F.regexp_replace(x, p, "")))

        return X.let(F.lower(text), lambda low: F.when(X.any_part(low, sum(_TAIL_PARTS, ())), told(low)).otherwise(text))

    def bare(text: Column) -> Column:
        # a space stands for what is taken out, so no part comes to be
        out = X.collapse(ruled(text, text, zip(D.SCRIPTS, _SCRIPT_PARTS, strict=True), "", lambda x, p: F.regexp_replace(x, p, " ")))
        return F.left(F.when(X.any_part(text, sum(_SCRIPT_PARTS, ())), out).otherwise(text), F.lit(most))

    return X.let(X.let(X.collapse(body), ended), bare)


def too_thin(clean: Column, chars: int = 150, words: int = 20) -> Column:
    """A cleaned body that holds no article."""
    return (F.length(_text(clean)) < chars) | (F.regexp_count(_text(clean), F.lit("[A-Za-z]{3,}")) < words)


def lede_score(sentence: Column) -> Column:
    """3 for a digit, 1 for each capitalised word up to three, 2 off for a pronoun in front."""
    digit = F.when(sentence.rlike(r"[0-9]"), 3).otherwise(0)
    names = F.least(F.regexp_count(sentence, F.lit(r"\b[A-Z][a-z]{2,}\b")), F.lit(3))
    pronoun = F.when(sentence.rlike(r"^\s*(?:He|She|It|They|His|Her|Its|Their|This|That)\b"), 2).otherwise(0)
    return digit + names - pronoun


def best_lede(body: Column) -> Column:
    """The sentence of the best score, the first of equals; null without sentences. A fold, no shuffle."""
    scored = F.transform(X.sentences(body), lambda s, k: F.struct(lede_score(s).alias("score"), (-k).alias("order"), s.alias("sentence")))
    return F.array_max(scored)["sentence"]


def low_value(sentence: Column) -> Column:
    return X.let(F.lower(X.collapse(sentence)), lambda low: F.coalesce(*(F.when(low.rlike(p), True) for p in D.LOW_VALUE_SENTENCES), F.lit(False)))


def style_tokens(c: Column | str) -> Column:
    """Distinct words of three characters and more, common ones left out, in order."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9][a-z0-9'-]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*D.STYLE_STOPWORDS)))


def designations(c: Column | str) -> Column:
    """Distinct names like F-16 or S-400, in order."""
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(r"\b[A-Z]{1,4}-[0-9]{1,4}[A-Z]?\b"), F.lit(0)))


def context_tail(title: Column, body: Column) -> Column:
    """The closing sentence of the topic that the whole article names first in the list."""
    text = F.lower(F.concat(F.lit(" "), _text(title), F.lit(" "), _text(body), F.lit(" ")))
    out = None
    for parts, tail in D.CONTEXT_TAILS:
        hit = X.any_part(text, parts)
        out = F.when(hit, tail) if out is None else out.when(hit, tail)
    return out.otherwise(D.CONTEXT_OTHERWISE)


def style_examples(articles: DataFrame, examples: DataFrame, k: int = 3, words_of: int = 900) -> DataFrame:
    """article_id, example, score, rank: the ``k`` examples (example, text, title, style) nearest an article's title and the
    first ``words_of`` characters of its body: 3 for each word shared with the example, 4 more for one of its title, 1 for
    one of its style; none without a shared word, equals by example.

    The examples meet all articles, so they have to be few: more than 1,000 are refused."""
    held = examples.select("example", style_tokens("text").alias("ts"), style_tokens("title").alias("tt"), style_tokens("style").alias("st")).limit(1001).collect()
    if len(held) > 1000:
        raise ValueError("examples are meant to be a short list, kept with each task")
    own = articles.select("article_id", style_tokens(F.concat_ws(" ", "title", F.left("body", F.lit(words_of)))).alias("_own"))
    if not held:
        return own.select("article_id", F.lit(0).cast("long").alias("example"), F.lit(0).alias("score"), F.lit(0).alias("rank")).limit(0)
    sets = F.array(*(F.struct(F.lit(e.example).cast("long").alias("example"), *(F.array(*map(F.lit, e[n])).cast("array<string>").alias(n) for n in ("ts", "tt", "st"))) for e in held))
    shared = lambda e, n: F.size(F.array_intersect("_own", e[n]))
    hits = F.filter(F.transform(sets, lambda e: F.struct((-3 * shared(e, "ts")).alias("o"), (-4 * shared(e, "tt") - shared(e, "st")).alias("more"), e["example"].alias("example"))), lambda h: h["o"] < 0)
    best = F.slice(F.array_sort(F.transform(hits, lambda h: F.struct((h["o"] + h["more"]).alias("order"), h["example"].alias("example")))), 1, k)
    return own.select("article_id", F.posexplode(best).alias("k", "h")).select("article_id", "h.example", (-F.col("h.order")).alias("score"), (F.col("k") + 1).alias("rank"))


def image_query(summary_title: Column, title: Column, body: Column, category: Column) -> Column:
    """Up to five distinct terms of title and lead with the category, else the title, else the category alone."""
    heading = F.trim(F.coalesce(F.nullif(summary_title, F.lit("")), _text(title)))
    # the lead is what the query is made of: its first 320 characters
    parts = F.filter(F.array(heading, _text(title), F.left(_text(body), F.lit(320))), lambda p: p != "")
    found = F.regexp_extract_all(F.lower(F.array_join(parts, " ")), F.lit("[a-z0-9]{4,}"), F.lit(0))
    terms = F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(*L.TITLE_STOPWORDS, *D.PICTURE_WORDS))), 1, 5)
    return (
        F.when(F.size(terms) > 0, F.concat(F.array_join(terms, " "), F.lit(" "), F.lower(_text(category)), F.lit(" news photo")))
        .when(heading != "", F.concat(heading, F.lit(" news photo"))).otherwise(F.concat(_text(category), F.lit(" breaking news photo")))
    )


def keyword_list(tags: Column) -> Column:
    """Up to ten distinct keywords of a line of tags, in any case, first spelling kept; 'news' if there are none."""
    found = F.filter(F.transform(F.split(F.trim(_text(tags)), r"[\s,]+"), lambda t: F.regexp_replace(t, "^#+", "")), lambda t: t != "")
    low = F.transform(found, F.lower)
    first = F.filter(found, lambda t, k: F.array_position(low, F.lower(t)) == k + 1)
    return F.when(F.size(first) == 0, F.array(F.lit("news"))).otherwise(F.slice(first, 1, 10))
