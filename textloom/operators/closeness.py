"""How close texts are by matching blocks, and what that decides: titles and bodies too close to their source.

The ratio of matching blocks (twice the characters matched over all characters) has no built-in function. Two bounds need
none of it: no more can match than the shorter text has, and no more of a letter than the text with fewer of it. Pairs that
the bounds settle reach the Python worker as nulls. There a third one is tried, what both have in the same order, which
takes a small part of the time; what is left is matched exactly."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import copy_lexicons as W
from ..functions import copyedit as E
from ..functions import text as X

#: Characters that are counted one by one; all others count as one kind.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "


def histogram(c: Column | str) -> Column:
    """How often a text has each of ``COUNTED``, then how many other characters."""
    c = F.coalesce(X.col(c), F.lit(""))
    counts = [F.length(c) - F.length(F.translate(c, letter, "")) for letter in COUNTED]
    others = F.length(F.translate(c, COUNTED, ""))
    return F.array(*counts, others)


def most_alike(a: Column, b: Column) -> Column:
    """The largest ratio that two histograms allow; 1 if both are empty."""
    total = lambda h: F.aggregate(h, F.lit(0), lambda s, n: s + n)
    both = total(a) + total(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / both)


def in_order(a: str, b: str) -> int:
    """The most characters that two texts have in common in the same order, by a bit-parallel table; matching blocks are
    never more."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    every = open_ = (1 << len(a)) - 1
    for c in b:
        if c in where:
            met = open_ & where[c]
            open_ = ((open_ + met) | (open_ - met)) & every
    return len(a) - open_.bit_count()


def _ratio(a: str, b: str, least: float) -> float | None:
    if 2.0 * in_order(a, b) < least * (len(a) + len(b)):
        return None
    return SequenceMatcher(None, a, b).ratio()


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Matching-blocks ratio of two strings; null for a null, and where it can't be ``least``."""
    # null: settled before; the bound a little lower, as it is rounded in another way than the ratio
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _ratio(x, y, least - 1e-9) for x, y in zip(a, b, strict=True)], dtype="float64")

    # pandas_udf reads the types at run time
    ratios.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratios, "double")(a, b)


def with_ratio(rows: DataFrame, a: str, b: str, least: float, out: str, only: Column | None = None, opened: str | None = None) -> DataFrame:
    """Adds ``out``: whether the ratio of columns ``a`` and ``b`` is ``least`` or more (and ``only`` holds).

    Lengths settle most pairs, letters most of the rest; ``opened`` names a column that tells which pairs were matched. A
    null counts as empty text."""
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in (a, b))
    short, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    open_ = (F.lit(True) if only is None else only) & ((both == 0) | (2.0 * short / both >= least))
    open_ = F.when(open_, most_alike(histogram(a), histogram(b)) >= least).otherwise(False)
    same = a == b
    rows = rows.withColumn(f"_{out}_open", open_ & ~same)
    sent = F.col(f"_{out}_open")
    rows = rows.withColumn(f"_{out}_ratio", ratio(F.when(sent, a), F.when(sent, b), least))
    alike = F.coalesce(F.col(f"_{out}_ratio") >= least, F.lit(False)) | (same & (F.lit(True) if only is None else only))
    rows = rows.withColumn(out, alike).drop(f"_{out}_ratio")
    return rows.withColumnRenamed(f"_{out}_open", opened) if opened else rows.drop(f"_{out}_open")


def titles_too_close(rows: DataFrame, title: str, source_title: str, least: float = 0.82) -> DataFrame:
    """Adds `too_close`: a title that takes its source's words.

    The same words; the same four in front; one inside the other; all but one of the shorter's telling words (three at
    least) or three quarters of all of them in both; or a ratio of ``least``. Null or without a word: not close."""
    def words(c: str) -> Column:
        return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: w != "")

    rows = rows.withColumns({"_tw": words(title), "_sw": words(source_title)})
    rows = rows.withColumns({"_tj": F.array_join("_tw", " "), "_sj": F.array_join("_sw", " "),
                             **{f"{n}s": F.array_distinct(F.filter(n, lambda w: ~w.isin(*W.COMPARED_WITHOUT))) for n in ("_tw", "_sw")}})
    t, s = F.col("_tws"), F.col("_sws")
    shared, union, short = F.size(F.array_intersect(t, s)), F.size(F.array_union(t, s)), F.least(F.size(t), F.size(s))
    plain = (
        (F.col("_tj") == F.col("_sj")) | ((F.size("_tw") >= 4) & (F.size("_sw") >= 4) & (F.slice("_tw", 1, 4) == F.slice("_sw", 1, 4)))
        | F.contains("_sj", F.col("_tj")) | F.contains("_tj", F.col("_sj"))
        | ((short > 0) & ((shared >= F.greatest(short - 1, F.lit(3))) | (shared / union >= 0.75)))
    )
    some = (F.size("_tw") > 0) & (F.size("_sw") > 0)
    rows = with_ratio(rows.withColumn("_plain", plain), "_tj", "_sj", least, "_near", some & ~F.col("_plain"))
    return rows.withColumn("too_close", some & (F.col("_plain") | F.col("_near"))).drop("_tw", "_sw", "_tws", "_sws", "_tj", "_sj", "_plain", "_near")


def _any_alike(texts: list[str | None], sources: list[str | None], least: float) -> bool:
    """Whether a text and a source have the ratio: what lengths and letters rule out is never matched."""
    others = [(b, Counter(b)) for b in dict.fromkeys(sources) if b is not None]
    for a in dict.fromkeys(texts):
        if a is None:
            continue
        letters = None
        for b, theirs in others:
            both = len(a) + len(b)
            if a == b:
                return True
            if 2.0 * min(len(a), len(b)) < (least - 1e-9) * both:
                continue
            letters = letters or Counter(a)
            if 2.0 * sum(min(n, theirs[c]) for c, n in letters.items() if c in theirs) < (least - 1e-9) * both:
                continue
            if (_ratio(a, b, least - 1e-9) or 0.0) >= least:
                return True
    return False


def sentence_matches(rows: DataFrame, texts: str, sources: str, least: float = 0.86, shortest: int = 40, settled: Column | None = None) -> DataFrame:
    """Adds `lifted`: whether a sentence of array ``texts`` of ``shortest`` characters has the ratio ``least`` with one of
    array ``sources``. Rows that ``settled`` names are known to have.

    Nothing leaves its row. A sentence that a source has as it is settles the row, and only what is left reaches Python."""
    long = F.filter(texts, lambda s: F.length(s) >= shortest)
    same = F.coalesce(F.arrays_overlap(long, sources), F.lit(False))
    rows = rows.withColumn("_same", same if settled is None else settled | same)

    def matches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and len(x) > 0 and _any_alike(list(x), list(y), least) for x, y in zip(a, b, strict=True)], dtype="bool")

    # pandas_udf reads the types at run time
    matches.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    alike = F.pandas_udf(matches, "boolean")(F.when(~F.col("_same"), long), F.when(~F.col("_same"), F.col(sources)))
    return rows.withColumn("lifted", alike).withColumn("lifted", F.col("_same") | F.col("lifted")).drop("_same")


def bodies_too_close(rows: DataFrame, id: str, body: str, source: str, whole: float = 0.80, least: float = 0.86, shortest: int = 40) -> DataFrame:
    """Adds `too_close`: a body of the ratio ``whole`` with its source, or with a sentence lifted from it. Null or empty
    texts are close to nothing. ``id`` is a key of the rows."""
    low = lambda c: F.lower(E.squeeze(c))
    told = lambda s: F.lower(E.body_marks(s))
    rows = rows.withColumns({"_bp": X.sentences(body), "_sp": X.sentences(source)})
    rows = rows.withColumns({"_b": low(body), "_s": low(source), "_bs": F.transform("_bp", told)})
    # sentences that are the same are so in plain marks, too: then the source's needn't be put in them
    kept = F.transform(F.arrays_zip("_bp", "_bs"), lambda p: F.when(F.length(p["_bs"]) >= shortest, p["_bp"]))
    rows = rows.withColumn("_taken", F.coalesce(F.arrays_overlap(F.array_compact(kept), "_sp"), F.lit(False)))
    rows = rows.withColumn("_ss", F.when(F.col("_taken"), F.array().cast("array<string>")).otherwise(F.transform("_sp", told)))
    some = (F.size("_bp") > 0) & (F.size("_sp") > 0)
    rows = with_ratio(rows, "_b", "_s", whole, "_near", some & ~F.col("_taken"))
    out = sentence_matches(rows, "_bs", "_ss", least, shortest, F.col("_taken"))
    return out.withColumn("too_close", some & (F.col("_near") | F.col("lifted"))).drop("_b", "_s", "_bp", "_sp", "_bs", "_ss", "_taken", "_near", "lifted")
