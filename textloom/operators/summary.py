"""Cards from an article's own sentences: which are taken under a budget, how the text is fitted, and its title.

Sentences are marked, counted and scored by column expressions (``copyedit.graded``). What depends on what was taken
before is a fold over the few sentences of one article's prose (5,200 characters at most), in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import copy_lexicons as W
from ..functions import copyedit as E
from ..functions import desk_lexicons as D
from ..functions import text as X
from . import closeness as C
from . import sentences as Z

_WORD = re.compile(r"[a-z0-9][a-z0-9'-]+")
_CUT = re.compile("|".join((*W.UNFINISHED, *W.BROKEN)))


def words_of(low: str) -> frozenset[str]:
    return frozenset(w for w in _WORD.findall(low) if len(w) >= 3 and w not in D.STYLE_STOPWORDS)


class Pick:
    """A sentence that may be taken, with what others are held against."""

    __slots__ = ("text", "low", "words", "_letters")

    def __init__(self, text: str, words=None):
        self.text, self.low = text, text.lower()
        self.words = words_of(self.low) if words is None else frozenset(words)
        self._letters = None

    @property
    def letters(self) -> Counter:
        # most sentences are told apart before their letters are counted
        if self._letters is None:
            self._letters = Counter(self.low)
        return self._letters

    def repeats(self, taken: list[Pick], least: float = 0.86) -> bool:
        """Says what one of ``taken`` says: the same, inside it (40 characters), many words or a matching-blocks ratio in
        common. A sentence without words repeats anything."""
        return not self.words or any(self.like(other, least) for other in taken)

    def like(self, other: Pick, least: float = 0.86) -> bool:
        if self.low == other.low or len(self.words & other.words) >= max(4, min(len(self.words), 6)):
            return True
        short, long = sorted((self.low, other.low), key=len)
        if len(short) >= 40 and short in long:
            return True
        both = len(short) + len(long)
        # no more can match than the shorter has, nor more of a letter than either has, nor more than both have in order
        if 2.0 * len(short) / both < least or 2.0 * (self.letters & other.letters).total() / both < least:
            return False
        if 2.0 * C.in_order(short, long) < (least - 1e-9) * both:
            return False
        return SequenceMatcher(None, self.low, other.low).ratio() >= least


def joined(taken: list[Pick]) -> str:
    return " ".join(p.text for p in taken)


def candidates(rows: list, title: str, taken: list[Pick]) -> Iterator[Pick]:
    """Sentences of 45 characters that say something new, best first; the title where there is hardly any.

    A sentence is new if it repeats nothing of ``taken`` and no new one before it. That is told when it is a sentence's
    turn, so the many that nobody comes to are never compared."""
    held, told = list(taken), {}
    picks = {k: Pick(r["text"], r["words"]) for k, r in enumerate(rows) if len(r["text"]) >= 45}

    def new(k: int) -> bool:
        if k not in told:
            told[k] = not picks[k].repeats(held) and not any(told.get(j, True) and picks[k].like(picks[j]) and new(j) for j in picks if j < k)
        return told[k]

    order = sorted(((-(rows[k]["base"] + 2 * (k <= 1) + rows[k]["named"]), k) for k in picks), key=lambda f: f[0])
    if not held and len(title) >= 35:
        found, last = [k for k in picks if new(k)], Pick(title)
        if len(found) < 2 and not last.repeats([picks[k] for k in found]):
            picks[-1], told[-1] = last, True
            order = sorted([*order, (-5, -1)], key=lambda f: f[0])
    yield from (picks[k] for _, k in order if new(k))


def chosen(rows: list, title: str, target: int = W.TARGET_CHARS, most: int = W.BODY_CHARS[1]) -> list[str]:
    """Sentences for a body of at most ``most`` characters.

    rows: the article's graded sentences in order; title in plain marks. One sentence is taken from each of three rankings
    (acts, numbers, consequences), skipping what repeats or doesn't fit. If the first repeats the title, the best other
    that fits takes its place, and they stand in the article's order. Then the best of the rest, up to four sentences or
    the target."""
    long = [r for r in rows if len(r["text"]) >= 35]
    if not long:
        return []
    picks = [Pick(r["text"], r["words"]) for r in long]
    base = [r["base"] + 2 * (k <= 1 and r["base"] > -999) for k, r in enumerate(long)]
    place, overlap = {r["text"]: k for k, r in enumerate(long)}, {r["text"]: r["overlap"] for r in long}
    taken: list[Pick] = []
    for plus, what in ((3, "acts"), (3, "number"), (4, "matters")):
        for k in sorted(range(len(long)), key=lambda k: (-(base[k] + plus * long[k][what]), k)):
            if not picks[k].repeats(taken) and len(joined([*taken, picks[k]])) <= most:
                taken.append(picks[k])
                break
    if len(taken) >= 3 and overlap[taken[0].text] >= 4:
        rest, options = taken[1:], []
        for k, pick in enumerate(picks):
            if pick.text != taken[0].text and not pick.repeats(rest):
                order = sorted([*rest, pick], key=lambda p: place[p.text])
                if len(joined(order)) <= most:
                    options.append((-(base[k] - 2 * long[k]["overlap"] + 3 * long[k]["matters"]), k, order))
        if options:
            taken = min(options, key=lambda o: o[:2])[2]
    for pick in candidates(rows, title, taken):
        body = joined([*taken, pick])
        if not pick.repeats(taken) and len(body) <= most:
            taken.append(pick)
            if len(body) >= target - 10 or len(taken) >= 4:
                break
    weak = {r["text"] for r in rows if r["weak"]}
    if len(joined(taken)) > target:
        while len(taken) > 1 and taken[-1].text in weak:
            taken.pop()
    return [p.text for p in taken]


def _choose(sentences: pd.Series, titles: pd.Series) -> pd.Series:
    return pd.Series([chosen(list(s) if s is not None else [], t or "") for s, t in zip(sentences, titles, strict=True)])


def pick_sentences(articles: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Adds `picked`: the sentences of an article's prose that make its body, in order. No shuffle.

    Null or empty bodies, and those without a sentence of 35 characters, pick nothing (a title of 35 may stand in where
    there is one such sentence at most)."""
    rows = articles.withColumns({"_sentences": X.sentences(Z.clean_body(F.col(body))), "_words": E.style_tokens(F.lower(E.body_marks(title)))})
    steps = E.graded(F.col("_sentences"), F.col("_words"))
    for name, column in steps:
        rows = rows.withColumn(name, column)
    picked = F.pandas_udf(_choose, "array<string>")(F.col("graded"), E.body_marks(title))
    return rows.withColumn("picked", picked).drop("_sentences", "_words", *(n for n, _ in steps))


# Fitting a text to its band.


def band(sentences: Column, most: int = W.BODY_CHARS[1]) -> Column:
    """Whole sentences from the start as long as they fit; if none does, the first cut at its last stop or word."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def add(state: Column, s: Column) -> Column:
        longer = F.when(state["text"] == "", s).otherwise(F.concat(state["text"], F.lit(" "), s))
        return E.let(longer, lambda x: F.struct(F.when(state["open"] & (F.length(x) <= most), x).otherwise(state["text"]).alias("text"), (state["open"] & (F.length(x) <= most)).alias("open")))

    def cut(head: Column) -> Column:
        stop = F.regexp_extract(head, r"(?s)\A(.{41,}[.!?])", 1)
        word = F.regexp_replace(F.regexp_replace(head, r"(?s)\A(.+) .*\z", "$1"), r"[ ,.\-]+\z", "")
        return F.when(head.rlike(r"(?s)\A.{41,}[.!?]"), stop).otherwise(word)

    def banded(parts: Column) -> Column:
        whole = F.aggregate(parts, start, add, lambda s: s["text"])
        return E.let(whole, lambda x: F.when(x != "", x).otherwise(E.let(F.left(F.array_join(parts, " "), F.lit(most)), cut)))

    return E.let(sentences, banded)


def without_loose_clause(sentence: Column) -> Column:
    """A sentence whose end was cut, ended before its last clause; null if nothing whole is left."""
    def before(bare: Column, mark: str) -> Column:
        at = F.length(bare) - F.instr(F.reverse(bare), mark[::-1]) - len(mark) + 1
        cut = F.concat(F.regexp_replace(F.left(bare, at), r"[ ,;\-]+\z", ""), F.lit("."))
        return F.when((F.instr(bare, mark) > 0) & (at > 40), E.let(cut, lambda x: F.when(~E.unfinished(x), x)))

    return E.let(F.regexp_replace(sentence, r"[ .!?]+\z", ""), lambda bare: F.coalesce(*(before(bare, mark) for mark in W.CLAUSE_BREAKS)))


def completed(body: Column, least: int = W.BODY_CHARS[0]) -> Column:
    """A body whose last sentence is whole: its loose clause goes if enough is left, else the sentence does."""
    def mended(parts: Column) -> Column:
        before = F.slice(parts, F.lit(1), F.size(parts) - 1)
        good = lambda x: F.when(~E.unfinished(x) & (F.length(x) >= least - 30), x)
        repaired = E.let(without_loose_clause(F.try_element_at(parts, F.lit(-1))), lambda last: F.when(last.isNotNull(), E.let(F.array_join(F.concat(before, F.array(last)), " "), good)))
        return F.coalesce(repaired, F.array_join(before, " "))

    return E.let(body, lambda x: F.when((x == "") | ~E.unfinished(x), x).otherwise(E.let(X.sentences(x), mended)))


def tidy(text: str, weak: set[str]) -> list[Pick]:
    """The sentences of a text that start well, are whole and don't repeat; weak ones at the end go while 220 characters
    and three sentences are left."""
    kept: list[Pick] = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        pick = Pick(s)
        if s and not re.match("[a-z]", s) and not _CUT.search(pick.low) and not pick.repeats(kept):
            kept.append(pick)
    while len(kept) > 3 and kept[-1].text in weak and len(joined(kept[:-1])) >= 220:
        kept.pop()
    return kept


def fitted(text: str, rows: list, title: str, tail: str, least: int = W.BODY_CHARS[0], target: int = W.TARGET_CHARS, most: int = W.BODY_CHARS[1]) -> str:
    """A text of whole sentences that is at least ``least`` characters long, if the article allows it: sentences of it that
    say something new are added, best first, then clauses of them, then ``tail``; nothing that would pass ``most``."""
    weak = {r["text"] for r in rows if r["weak"]}
    taken = tidy(text, weak)
    for pick in candidates(rows, title, taken) if len(joined(taken)) < least else ():
        if len(joined([*taken, pick])) <= most and not _CUT.search(pick.low):
            taken.append(pick)
        if len(joined(taken)) >= target - 5:
            break
    if len(joined(taken)) < least:
        sources = [r["text"] for r in rows if r["overlap"] < 4 and not Pick(r["text"], r["words"]).repeats(taken)]
        for clause in (c.strip(" ,.-") for s in sources for c in re.split("[,;]", s)):
            pick = Pick(f"{clause[:1].upper()}{clause[1:]}.")
            if len(clause) >= 20 and not _CUT.search(pick.low) and clause not in joined(taken) and not pick.repeats(taken) and len(joined([*taken, pick])) <= most:
                taken.append(pick)
            if len(joined(taken)) >= target - 5:
                break
    if len(joined(taken)) < least and len(f"{joined(taken)} {tail}") <= most:
        taken.append(Pick(tail))
    return joined(taken)


def _fit(texts: pd.Series, sentences: pd.Series, titles: pd.Series, tails: pd.Series) -> pd.Series:
    return pd.Series([fitted(x or "", list(s) if s is not None else [], t or "", z) for x, s, t, z in zip(texts, sentences, titles, tails, strict=True)])


def own_title(title: Column, names: Column, designations: Column) -> Column:
    """A title in house style: no publisher, no commas, sentence case, names and designations as the source has them."""
    out = E.without_commas(E.title_marks(E.acronyms(E.without_noise(title))))
    return E.cut_title(E.restore_designations(E.restore_names(E.sentence_case(out), names), designations))


def needs_caution(title: Column | str, body: Column | str) -> Column:
    """A source that doubts what it tells, or tells what pictures seem to show."""
    low = F.lower(F.concat(F.lit(" "), E.acronyms(title), F.lit(" "), E.acronyms(body), F.lit(" ")))
    return E.any_of(low, W.UNCERTAIN) | (E.any_of(low, W.PICTURED) & E.any_of(low, W.PICTURE_CLAIMS))


def has_proof(title: Column | str, body: Column | str) -> Column:
    """A text that says it was verified, unless it says anywhere that it wasn't."""
    low = F.lower(F.concat(F.lit(" "), E.acronyms(title), F.lit(" "), E.acronyms(body), F.lit(" ")))
    return ~E.any_of(low, W.DISPROOF) & E.any_of(low, D.PROOF)


def credible(title: Column, body: Column, source_title: Column, source_body: Column, designations: Column) -> Column:
    """A card that keeps its source's doubts, claims no proof of its own, and names the source's designations alone."""
    low = F.lower(F.concat_ws(" ", title, body))
    said = F.concat(F.lit(" "), E.acronyms(title), F.lit(" "), E.acronyms(body), F.lit(" "))
    key = lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", "")
    of_card = F.transform(E.source_designations(title, body), key)
    single = F.array_distinct(F.transform(designations, key))
    named = (F.size(single) != 1) | F.rlike(said, F.coalesce(E.designation_pattern(F.try_element_at(designations, F.lit(-1))), F.lit("")))
    return (
        (~needs_caution(source_title, source_body) | E.any_of(low, D.CAUTION)) & named
        & (has_proof(source_title, source_body) | ~E.any_of(F.lower(said), D.PROOF)) & ((F.size(single) == 0) | (F.size(F.array_except(of_card, single)) == 0))
    )


def cards(articles: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Adds `card_title` (16 to 80 characters) and `card_body` (230 to 360): both or neither.

    Null where the article can't fill them or the card would not be credible. The prose is what ``sentences.clean_body``
    leaves. The title comes from the source's title; if that is too close to it, from the first clause of the first three
    sentences that isn't. No shuffle; two Python steps, both over single rows."""
    helper = lambda n: f"_card_{n}"
    rows = articles.withColumn(helper("prose"), Z.clean_body(F.col(body)))
    prose = F.col(helper("prose"))
    rows = rows.withColumns({helper("names"): E.source_names(title, prose), helper("named"): E.source_designations(title, prose), helper("marked"): E.body_marks(title)})
    names, named, marked = (F.col(helper(n)) for n in ("names", "named", "marked"))
    rows = rows.withColumns({"_sentences": X.sentences(prose), "_words": E.style_tokens(F.lower(marked))})
    steps = E.graded(F.col("_sentences"), F.col("_words"))
    for name, column in steps:
        rows = rows.withColumn(name, column)
    rows = rows.withColumn(helper("picked"), F.pandas_udf(_choose, "array<string>")("graded", marked))
    text = E.acronyms(E.body_marks(F.array_join(helper("picked"), " ")))
    text = E.restore_designations(E.first_acronyms(text, F.col(title), prose), named)
    # a doubtful source's first doubt comes first
    doubt = F.try_element_at(F.filter("graded", lambda s: E.any_of(F.lower(s["text"]), W.UNCERTAIN)), F.lit(1))["text"]
    text = F.when(needs_caution(F.col(title), prose) & ~E.any_of(F.lower(text), D.CAUTION) & doubt.isNotNull(), F.concat(doubt, F.lit(" "), text)).otherwise(text)
    rows = rows.withColumn(helper("text"), text)
    fit = F.pandas_udf(_fit, "string")(helper("text"), "graded", marked, Z.context_tail(F.col(title), prose))
    rows = rows.withColumn(helper("fit"), fit)
    rows = rows.withColumn(helper("body"), E.body_marks(completed(band(X.sentences(helper("fit"))))))

    clause = lambda s: F.btrim(F.try_element_at(F.split(s["text"], r"[,:;]\s+"), F.lit(1)), F.lit(" .,-"))
    tries = F.filter(F.transform(F.filter(F.slice("graded", 1, 3), lambda s: F.length(s["text"]) >= 24), clause), lambda c: F.length(c) >= 16)
    # the first clause that isn't the source's title in other words: by common words, as the ratio is taken once below
    fresh = F.filter(tries, lambda c: F.size(F.array_intersect(E.style_tokens(F.lower(c)), F.col("_words"))) < 3)
    rows = rows.withColumns({helper("title"): own_title(F.col(title), names, named), helper("other"): own_title(F.try_element_at(fresh, F.lit(1)), names, named)})
    rows = C.titles_too_close(rows, helper("title"), title).withColumnRenamed("too_close", helper("close"))
    pick = F.when(F.col(helper("close")) & (F.length(helper("other")) >= W.TITLE_CHARS[0]), F.col(helper("other"))).otherwise(F.col(helper("title")))
    rows = rows.withColumn(helper("title"), pick)
    card_title, card_body = F.col(helper("title")), F.col(helper("body"))
    good = F.length(card_title).between(*W.TITLE_CHARS) & F.length(card_body).between(*W.BODY_CHARS) & credible(card_title, card_body, F.col(title), prose, named)
    rows = rows.withColumns({"card_title": F.when(good, card_title), "card_body": F.when(good, card_body)})
    return rows.drop("_sentences", "_words", *(n for n, _ in steps), *(c for c in rows.columns if c.startswith("_card_")))
