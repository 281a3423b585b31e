"""Spelling variants: words of a corpus that are one edit apart, and the frequent form that each leads to.

Asymmetric q-chunks. A word of L letters is cut in two disjoint chunks of about L/2. The other word of a pair, as long or a
letter longer, gives its positional grams; one edit leaves one of the two chunks whole, and it is found among the grams at
its own place or shifted by one. Only the grams that such a chunk can meet are sent: a word's own chunks, and for words a
letter shorter its beginning and its end. Gram and place are the key of an equi-join; what meets is verified by edit
distance.

Chunks that very many words share would pair all of them. A bucket of over ``BUCKET`` rows is therefore not joined: the
part of the word that isn't known to be equal is itself cut in two chunks, one of which has to be whole, and is added to
the key. After at most log2(L) cuts only one letter is open, and a bucket holds no more words than there are letters. No
pair is lost and no bucket is dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scope

#: Fixed values of the contract.
RUN, ONE_IN, SHORTEST, LEAST = r"[A-Za-zÀ-ÿ]", 97, 5, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a key that are compared with each other at once.
BUCKET = 48


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that occur ``least`` times in all documents.

    A word is a maximal run of letters with A-Z lower-cased. In one of ``one_in`` (document, run) pairs, told by a crc32, a
    letter is missing. A null text has no words; a null doc_id counts as an empty one."""
    # a missing letter only shortens: shorter runs can't become words
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))).alias("_run"))
    runs = runs.select("_doc", F.translate("_run", _UPPER, _LOWER).alias("_run"))
    h = F.crc32(F.concat("_doc", F.lit(":"), "_run").cast("binary"))
    at = (h % F.length("_run")).cast("int")
    short = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    word = F.when(h % one_in == 0, short).otherwise(F.col("_run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _key(size: Column, start: Column, end: Column, longer: Column) -> Column:
    """What a word shows of itself when ``start`` to ``end`` of a word of ``size`` letters is open.

    Words have letters only, so digits and colons keep the parts apart."""
    word = F.col("word")
    before, after = F.substring(word, F.lit(1), start), F.substring(word, end + longer.cast("int") + 1, F.length(word))
    return F.concat(size.cast("string"), F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":"), before, F.lit(":"), after)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, longer, size, start, end) with their `key`."""
    return rows.select("*", _key(F.col("size"), F.col("start"), F.col("end"), F.col("longer")).alias("key"))


def _chunks(counts: DataFrame) -> DataFrame:
    """Each word's two chunks, which are also its grams for words of its length, and its grams for those a letter shorter."""
    size = F.length("word")
    shapes = [(longer, first) for longer in (False, True) for first in (True, False)]

    def row(longer: bool, first: bool) -> Column:
        of = size - int(longer)
        half = F.floor(of / 2).cast("int")
        return F.struct(F.lit(longer).alias("longer"), of.cast("int").alias("size"), (half if first else F.lit(0)).alias("start"), (of if first else half).cast("int").alias("end"))

    return _keyed(counts.select("word", "n", F.explode(F.array(*[row(*s) for s in shapes])).alias("_c")).select("word", "n", "_c.*"))


def _halved(rows: DataFrame) -> DataFrame:
    """The open part of each row cut in two, one of them open: an edit in it leaves the other whole."""
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    parts = F.array(F.struct(F.col("start"), middle.alias("end")), F.struct(middle.alias("start"), F.col("end")))
    return _keyed(rows.select("word", "n", "longer", "size", F.explode(parts).alias("_c")).select("word", "n", "longer", "size", "_c.*"))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs under one key that are one edit apart."""
    left = rows.filter(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = rows.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    pairs = left.join(right, "key").filter(F.col("longer") | (F.col("a") < F.col("b")))
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def near_words(scope: Scope, counts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words that exactly one inserted, deleted or replaced letter parts, once."""
    rows, found = _chunks(counts), []
    while True:
        sizes = rows.groupBy("key").agg(F.count_if(~F.col("longer")).alias("_own"), F.count_if(F.col("longer")).alias("_longer"))
        # alone, or without a word of the chunk's own length: nothing to meet
        sizes = sizes.filter((F.col("_own") > 0) & (F.col("_own") + F.col("_longer") > 1)).select("key", (F.col("_own") + F.col("_longer")).alias("_rows"))
        rows = scope.store(rows.join(sizes, "key"), "word-chunks")
        large = (F.col("_rows") > bucket) & (F.col("end") - F.col("start") > 1)
        found.append(_met(rows.filter(~large)))
        rows = rows.filter(large).drop("_rows", "key")
        if rows.isEmpty():
            break
        rows = _halved(rows)
    # a doubled letter leaves both chunks whole, and a bucket's pair may meet under both halves
    return reduce(DataFrame.unionByName, found).distinct()


def _roots(scope: Scope, forms: DataFrame) -> DataFrame:
    """(word, root) for each word that has a form; each round doubles the steps followed.

    A form occurs twice as often as its word at least, so chains have no cycles and at most log2 of the largest count."""
    at = scope.store(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = scope.store(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "word-roots")
        at = after.select("word", "root")
        if after.filter("_moved").isEmpty():
            return at


def variants(counts: DataFrame, bucket: int = BUCKET, times: int = 2) -> DataFrame:
    """For each (word, n): its `form`, the near word that occurs most (ties: the smaller in code-point order) if it occurs
    ``times`` as often as the word, `root`, the last form, and `n_near` and `form_n`.

    Words are taken as distinct and not null, as ``words`` returns them. An empty table gives no rows."""
    with Scope(counts.sparkSession) as scope:
        counts = scope.store(counts.select("word", "n"), "word-counts")
        pairs = near_words(scope, counts, bucket)
        both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
                                              F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))).alias("_p")).select("_p.*")
        best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("_best"))
        all_words = counts.join(best, "word", "left")
        enough = -F.col("_best.minus") >= times * F.col("n")
        all_words = scope.store(all_words.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("_best.other")).alias("form"), F.when(enough, -F.col("_best.minus")).alias("form_n"),
        ), "word-forms")
        roots = _roots(scope, all_words.filter("form IS NOT NULL"))
        out = all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return scope.result(out, "spelling-variants")


def group_variants(docs: DataFrame) -> DataFrame:
    return variants(words(docs))
