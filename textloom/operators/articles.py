"""Articles: filters, categories, priorities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X


def relevance_reason(title: Column, body: Column, url: Column) -> Column:
    """The first gate that an article fails, null if none."""
    url = F.lower(F.coalesce(url, F.lit("")))

    def reason(x: Column) -> Column:
        return (
            F.when(F.length(x["title"]) < L.MIN_TITLE_CHARS, "title_short")
            .when(F.length(x["body"]) < L.MIN_BODY_CHARS, "body_short")
            .when(X.any_part(x["low"], L.IRRELEVANT), "irrelevant")
            .when(X.any_part(url, L.LOW_VALUE_URLS), "low_value_url")
            .when(X.any_part(x["low"], L.LOW_VALUE_TITLES), "low_value_title")
        )

    clean = F.struct(X.collapse(title).alias("title"), X.collapse(body).alias("body"))
    return X.let(X.let(clean, lambda x: F.struct(x["title"], x["body"], F.lower(F.concat(x["title"], F.lit(" "), x["body"])).alias("low"))), reason)


def matches_category(category: str, title: Column, body: Column, url: Column, source: Column, source_url: Column) -> Column:
    """Whether an article belongs to a category; it must pass the relevance gates first."""
    content = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    every = F.lower(F.concat_ws(" ", content, F.coalesce(url, F.lit(""))))
    return relevance_reason(title, body, url).isNull() & X.let(_read(content, every), lambda t: _verdict(category, t, source, source_url))


def _read(content: Column, every: Column) -> Column:
    """What category rules ask of texts in lower case, title and body and both with the url, read once."""
    words = F.struct(content.alias("content"), every.alias("every"), X.token_set(content).alias("words"), X.token_set(every).alias("every_words"))

    def marked(t: Column) -> Column:
        every, tokens = t["every"], t["every_words"]
        abroad = X.any_keyword(every, L.INTERNATIONAL_MARKERS, tokens) | (X.has_keyword(every, "us", tokens) & X.has_keyword(every, "israel", tokens))
        return F.struct(t["content"].alias("content"), every.alias("every"), t["words"].alias("words"), tokens.alias("every_words"), abroad.alias("abroad"),
                        X.any_part(every, L.INDIA_MARKERS).alias("india"), X.any_part(every, L.LOCAL_POLITICS).alias("local"))

    return X.let(words, marked)


def _verdict(category: str, text: Column, source: Column, source_url: Column) -> Column:
    """The category's own rule, from what ``_read`` found."""
    source, source_url = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(source_url, F.lit("")))
    hinted = lambda c: X.any_part(source_url, L.SOURCE_HINTS[c])
    abroad_source, india_source = X.any_part(F.trim(source), L.INTERNATIONAL_SOURCES), X.any_part(source, L.INDIA_SOURCES)
    content, every, words, india, local, abroad = (text[n] for n in ("content", "every", "words", "india", "local", "abroad"))
    any_of = X.any_keyword(content, L.CATEGORY_KEYWORDS[category], words)
    if category == "international":
        verdict = (
            F.when(hinted("national") & ~abroad, False)
            .when(india & ~abroad & ~abroad_source, False)
            .when(abroad, True)
            .when((hinted("international") | abroad_source) & ~(india & local), True)
            .otherwise(any_of)
        )
    elif category == "national":
        verdict = (
            F.when(hinted("national"), F.when(abroad & ~local, False).otherwise(india | X.any_keyword(every, L.CATEGORY_KEYWORDS["national"], text["every_words"])))
            .when(india_source | india, ~(abroad & ~local))
            .otherwise(any_of)
        )
    elif category == "politics":
        signal = X.keyword_count(content, L.CATEGORY_KEYWORDS["politics"], words)
        verdict = (hinted("politics") & (signal > 0)) | (signal >= 2) | X.any_keyword(content, L.POLITICS_STRONG, words)
    else:
        verdict = any_of
    return verdict


def categorised(articles: DataFrame, categories: tuple[str, ...] = tuple(L.CATEGORY_KEYWORDS)) -> DataFrame:
    """A row for each article and category that it matches. The gates drop articles before any category is asked, and the
    texts that keywords are looked up in are made once, as columns."""
    rows = articles.where(relevance_reason(F.col("title"), F.col("body"), F.col("url")).isNull())
    content = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    texts = X.let(content, lambda c: _read(c, F.lower(F.concat_ws(" ", c, F.coalesce("url", F.lit(""))))))
    flags = X.let(texts, lambda t: F.array_compact(F.array(*(F.when(_verdict(c, t, F.col("source"), F.col("source_url")), c) for c in categories))))
    return rows.withColumn("category", F.explode(flags))


def fresh(published: Column, now: Column, minutes: int = 1440, required: bool = False) -> Column:
    """Not older than the limit; unknown times pass unless required. Times ahead of now pass."""
    at = F.try_to_timestamp(F.nullif(F.trim(published), F.lit("")))
    return F.when(at.isNull(), F.lit(not required)).otherwise(at >= now - F.expr(f"INTERVAL {minutes} MINUTES"))


def priority(text: Column, category: Column, groups: Mapping[str, tuple[str, ...]] = L.PRIORITY_KEYWORDS) -> Column:
    """1 for each general keyword, 3 for each of the category's own."""
    bucket = F.when(category == "tech", "technology").otherwise(category)
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))

    def counted(x: Column) -> Column:
        own = None
        for name, keywords in groups.items():
            if name != "general":
                count = X.keyword_count(x["low"], keywords, x["words"])
                own = F.when(bucket == name, count) if own is None else own.when(bucket == name, count)
        return X.keyword_count(x["low"], groups["general"], x["words"]) + 3 * own.otherwise(F.lit(0))

    return X.let(X.let(low, lambda t: F.struct(t.alias("low"), X.token_set(t).alias("words"))), counted)


def source_rank(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.when(X.any_part(low, ("toi", "times of india", "india today")), 0).when(low.contains("aljazeera"), 1).when(low.contains("bbc"), 2).when(low.contains("ndtv"), 5).otherwise(4)


def validation_error(title: Column, body: Column, category: Column, categories: tuple[str, ...], has_image: Column) -> Column:
    """The first rule that a card breaks, null if none."""
    (t0, t1), (b0, b1) = L.CARD_TITLE, L.CARD_BODY
    n, m = F.length(F.coalesce(title, F.lit(""))), F.length(F.coalesce(body, F.lit("")))
    low = F.lower(X.collapse(body))
    boilerplate = low.rlike(L.CARD_BOILERPLATE[0]) | low.rlike(L.CARD_BOILERPLATE[1])
    return (
        F.when(n < t0, "title_short").when(n > t1, "title_long").when(title.contains(","), "title_comma").when(title.contains("!"), "title_exclamation")
        .when(m < b0, "body_short").when(m > b1, "body_long").when(boilerplate, "body_boilerplate")
        .when(~category.isin(*categories) | category.isNull(), "category").when(~has_image, "image")
    )


def ranked(rows: DataFrame, by: list[Column], group: str = "category", name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*by)))


def quota_plan(pools: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Rows taken under the plan: pools has category, breaking and rank within (category, breaking); plan has category,
    pos, total and target. Up to the target breaking rows come first and normal ones fill up; then normal before breaking;
    the whole is cut at ``most`` in plan order. Ranks past a category's total never count, so they are dropped first."""
    w = Window.partitionBy("category")
    rows = pools.join(F.broadcast(plan), "category").where(F.col("rank") <= F.col("total"))
    rows = rows.withColumn("n_breaking", F.sum(F.col("breaking").cast("int")).over(w)).withColumn("n_normal", F.sum((~F.col("breaking")).cast("int")).over(w))
    first_b = F.least("target", "n_breaking", "total")
    first_n = F.least(F.least("target", "total") - first_b, F.col("n_normal"))
    rows = rows.withColumns({"first_b": first_b, "first_n": first_n})
    turn = (
        F.when(F.col("breaking") & (F.col("rank") <= F.col("first_b")), F.col("rank"))
        .when(~F.col("breaking"), F.col("first_b") + F.col("rank"))
        .otherwise(F.col("n_normal") + F.col("rank"))
    )
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= F.col("total"))
    rows = rows.withColumn("as_breaking", F.col("breaking") | (F.col("rank") <= F.col("first_n")))
    # at most a plan's total rows are left, so one task may number them
    return rows.withColumn("slot", F.row_number().over(Window.orderBy("pos", "turn"))).where(F.col("slot") <= most).select(*pools.columns, "turn", "as_breaking", "slot")
