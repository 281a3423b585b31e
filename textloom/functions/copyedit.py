"""Copy rules as column expressions: marks, acronyms, names, cases, and what kind of sentence it is. Null is empty text;
nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import copy_lexicons as W
from . import text as X
from .desk_lexicons import LOW_VALUE_SENTENCES, STYLE_STOPWORDS
from .text import let

_EDGE = " ,.-:"


def squeeze(c: Column | str) -> Column:
    """Single spaces for white space of any kind, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(X.col(c), F.lit("")), r"(?U)\s+", " "))


def _strip(c: Column, marks: str = _EDGE) -> Column:
    return F.btrim(c, F.lit(marks))


def any_of(low: Column, parts) -> Column:
    """Whether one of some plain parts is anywhere in a text. Plain search is faster than one pattern of many branches."""
    return X.any_part(low, parts)


def starts(low: Column, parts) -> Column:
    return reduce(or_, (low.startswith(p) for p in parts))


def plain_marks(c: Column) -> Column:
    single = {k: v for k, v in W.MARKS.items() if len(v) == 1}
    for mark, other in W.MARKS.items():
        if len(other) != 1:
            c = F.replace(c, F.lit(mark), F.lit(other))
    return F.translate(c, "".join(single), "".join(single.values()))


# What a text has that ``body_marks`` may change, publishers' names aside: most sentences have none of it.
_UNMARKED = r"[ .U\t\n\x0B\f\r](?:(?<= )[ ,.;:!?]|(?<=\.)\.|(?<=U)S\.|(?<=[\t\n\x0B\f\r]))"
_ODD_MARKS = rf"(?![ -~])[\p{{IsWhite_Space}}{''.join(W.MARKS)}]"
_PAPER_PARTS = ("times of india", "india today", "bbc news", "jazeera")


def body_marks(c: Column | str) -> Column:
    """A sentence or body in plain marks, without publishers' names, ended by a full stop; empty stays empty."""
    def marked(text: Column) -> Column:
        out = F.regexp_replace(plain_marks(text), r"\s+([,.;:!?])", "$1")
        out = F.regexp_replace(out, rf"(?i)\s*-\s*{W.PAPERS}\.?", ".")
        out = F.regexp_replace(out, rf"(?i)(?:\b{W.PAPERS}\b\.?\s*)+", "")
        for pattern, other in ((r"\s+'", " '"), (r"'\s+", "' "), (r"\bUS\.(?=[-A-Z])", "US"), (r"(?<![.!?])\z", "."), (r"\.\.+", ".")):
            out = F.regexp_replace(out, pattern, other)
        return out

    squeezed = lambda c: let(squeeze(c), lambda x: F.when(x == "", x).otherwise(marked(x)))

    def guarded(x: Column) -> Column:
        ended = x.endswith(".") | x.endswith("!") | x.endswith("?") | (x == "")
        odd = ~ended | x.startswith(" ") | x.rlike(_UNMARKED) | ((F.length(x) < F.octet_length(x)) & x.rlike(_ODD_MARKS)) | any_of(F.lower(x), _PAPER_PARTS)
        return F.when(odd, squeezed(x)).otherwise(x)

    text = F.coalesce(X.col(c), F.lit(""))
    return guarded(text) if isinstance(c, str) else let(text, guarded)


def acronyms(c: Column | str) -> Column:
    out = F.btrim(F.coalesce(X.col(c), F.lit("")))
    for pattern, short in W.DOTTED:
        out = F.regexp_replace(out, f"(?i){pattern}", short)
    out = F.regexp_replace(out, r"\b(US|UK|UN|EU|UAE)\.(?=\s+[A-Z])", "$1")
    # a letter after US- at a word's start is a capital
    return F.array_join(F.transform(F.split(out, r"\b(?=US-[a-z])", -1), lambda p: F.when(p.rlike("^US-[a-z]"), F.concat(F.lit("US-"), F.upper(F.substring(p, 4, 1)), F.substring(p, F.lit(5), F.length(p)))).otherwise(p)), "")


def without_noise(title: Column | str) -> Column:
    """A title without its publisher and 'live updates' at the end."""
    out = squeeze(title)
    for pattern in W.TITLE_ENDS:
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    return F.btrim(squeeze(out), F.lit(" -|:"))


def title_marks(title: Column | str) -> Column:
    out = F.regexp_replace(plain_marks(squeeze(title)), r"\s+([,.;:!?])", "$1")
    return F.btrim(F.regexp_replace(out, rf"(?i),\s+({'|'.join(W.COLON_VERBS)})\b", ": $1"))


def without_commas(title: Column | str) -> Column:
    out = F.regexp_replace(squeeze(title), r"\s*,\s*", " ")
    return _strip(F.regexp_replace(F.regexp_replace(out, r"\s*:\s*:\s*", ": "), r"\s{2,}", " "), " ,.-:")


def _upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.length(c)))


def sentence_case(title: Column | str) -> Column:
    """A capital in front and after colons, known acronyms in capitals, all else as it is."""
    out = let(squeeze(title), _upper_first)
    for word in sorted(W.ALWAYS_UPPER, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?i)\b{word}\b", word.upper())
    # "a:  b" to "a: B", and only where a small letter follows
    parts = F.split(out, r":(?=\s*[a-z])", -1)
    return F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit(" "), _upper_first(F.ltrim(p))))), ":")


def title_case(title: Column | str) -> Column:
    """Capitals for all but small words inside; short words that are capitals already stay so."""
    def cased(words: Column, word: Column, k: Column) -> Column:
        core = F.regexp_extract(word, r"^[^A-Za-z0-9]*([A-Za-z0-9.-]+)[^A-Za-z0-9]*$", 1)
        bare = F.replace(core, F.lit("."), F.lit(""))
        shouted = bare.rlike("[A-Z]") & ~bare.rlike("[a-z]") & F.length(bare).between(2, 6)
        low = F.lower(word)
        edge = (k == 0) | (k == F.size(words) - 1)
        known = F.regexp_replace(low, "[^a-z0-9]", "").isin(*W.ALWAYS_UPPER)
        return F.when(shouted, word).when(known, F.upper(word)).when(edge | ~low.isin(*W.SMALL_WORDS), F.concat(F.upper(F.left(word, F.lit(1))), F.substring(low, F.lit(2), F.length(low)))).otherwise(low)

    return let(F.split(squeeze(title), " "), lambda words: F.array_join(F.transform(words, lambda w, k: cased(words, w, k)), " "))


def cut_title(title: Column | str, most: int = W.TITLE_CHARS[1]) -> Column:
    """A title of at most ``most`` characters, cut at a space where one is near the end."""
    def cut(out: Column) -> Column:
        head = F.left(out, F.lit(most + 1))
        # a colon or a dash before the last space never moves the cut past it
        at = F.length(head) - F.instr(F.reverse(head), " ")
        end = F.when((F.instr(F.reverse(head), " ") > 0) & (at >= most - 12), F.left(head, at)).otherwise(F.left(out, F.lit(most)))
        return F.when(F.length(out) <= most, out).otherwise(F.regexp_replace(end, r"[ ,.\-:]+\z", ""))

    return let(_strip(squeeze(title)), cut)


# Names, designations and acronyms as a row's own source has them.


def source_names(title: Column | str, body: Column | str) -> Column:
    """Words with a capital inside a sentence of the source, each as it is last written, in order of first mention; then
    well-known names."""
    text = F.concat(F.coalesce(X.col(title), F.lit("")), F.lit(" "), F.coalesce(X.col(body), F.lit("")))
    inside = F.flatten(F.transform(F.filter(F.split(squeeze(text), r"(?<=[.!?])\s+"), lambda s: s != ""), lambda s: F.slice(F.split(s, " "), F.lit(2), F.size(F.split(s, " ")))))
    bare = F.transform(inside, lambda w: F.regexp_replace(w, "[^A-Za-z'’-]", ""))
    found = F.filter(bare, lambda w: (F.length(w) >= 3) & w.rlike("^[A-Z]") & w.rlike("[a-z]"))
    return F.concat(found, F.array(*(F.lit(n[:1].upper() + n[1:]) for n in W.PROPER_NOUNS)))


def restore_names(text: Column | str, names: Column) -> Column:
    """``text`` with the names of its source (an array column) as the source writes them, at word bounds.

    A name only changes the case of letters that are there, so a text goes through once, looking only for names whose
    letters it has. Of spellings of one name the source's last counts; a source's spelling goes before a well-known one."""
    known = F.array(*(F.lit(n[:1].upper() + n[1:]) for n in W.PROPER_NOUNS))

    def restored(text: Column, here: Column) -> Column:
        def written(out: Column, key: Column) -> Column:
            # the last spelling of the source; the list of well-known names, at the end, counts if there is none
            spelled = let(F.filter(here, lambda n: F.lower(n["name"]) == key), lambda x: F.coalesce(F.try_element_at(F.filter(x, lambda n: n["own"]), F.lit(-1)), F.element_at(x, 1)))
            return F.regexp_replace(out, F.concat(F.lit(r"(?iU)\b"), key, F.lit(r"\b")), spelled["name"])

        return F.aggregate(F.array_distinct(F.transform(here, lambda n: F.lower(n["name"]))), text, written)

    def found(text: Column) -> Column:
        marked = F.transform(names, lambda n, k: F.struct(n.alias("name"), (k < F.size(names) - F.size(known)).alias("own")))
        return let(F.filter(marked, lambda n: F.contains(F.lower(text), F.lower(n["name"]))), lambda here: restored(text, here))

    return let(F.coalesce(X.col(text), F.lit("")), found)


def source_designations(title: Column | str, body: Column | str) -> Column:
    """Names like F-16 or S-400 of a source, in order; of two spellings of one the last counts."""
    text = acronyms(F.concat(F.coalesce(X.col(title), F.lit("")), F.lit(" "), F.coalesce(X.col(body), F.lit(""))))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{1,4}-[0-9]{1,4}[A-Z]?\b"), F.lit(0)))


def designation_pattern(name: Column) -> Column:
    """Finds a designation however its parts are set apart."""
    apart = r"[\\s-]*"
    return F.concat(F.lit(r"(?i)\b"), F.regexp_replace(F.regexp_replace(name, "-", apart), "([0-9])([A-Z])$", f"$1{apart}$2"), F.lit(r"\b"))


def restore_designations(text: Column | str, designations: Column) -> Column:
    return F.aggregate(designations, F.coalesce(X.col(text), F.lit("")), lambda out, name: F.regexp_replace(out, designation_pattern(name), name))


def first_acronyms(text: Column | str, title: Column | str, body: Column | str) -> Column:
    """Long forms at their first mention are followed by the acronym, if the source has that."""
    source = F.concat(F.coalesce(X.col(title), F.lit("")), F.lit(" "), F.coalesce(X.col(body), F.lit("")))
    out = F.coalesce(X.col(text), F.lit(""))
    for long, short in W.LONG_FORMS.items():
        once = rf"(?is)\A(.*?)\b{long}\b(?!\s*\({short}\))"
        # what isn't to be done looks for the end of the text's end
        out = F.regexp_replace(out, F.when(source.rlike(rf"(?i)\b{short}\b"), F.lit(once)).otherwise(F.lit(r"\z.")), F.lit(f"$1{long} ({short})"))
    return out


# What kind of sentence it is.


def style_tokens(low: Column) -> Column:
    """Distinct words of three characters and more, common ones left out."""
    return F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9][a-z0-9'-]{2,}"), F.lit(0)), lambda w: ~w.isin(*STYLE_STOPWORDS)))


def has_number(c: Column) -> Column:
    """A number that is a word of its own. The digit comes first in the pattern, as bounds are dear to look for."""
    return c.rlike(r"[0-9](?<=\b[0-9])[0-9]*\b")


def low_value(low: Column) -> Column:
    return low.rlike("|".join(LOW_VALUE_SENTENCES)) | (F.trim(low) == "")


def unfinished(c: Column | str) -> Column:
    """A text whose last clause was cut."""
    return F.lower(squeeze(c)).rlike("|".join(W.UNFINISHED))


def broken(marked: Column) -> Column:
    """A sentence (of ``body_marks``) that was cut or has no verb of its own."""
    return (marked == "") | unfinished(marked) | F.lower(marked).rlike("|".join(W.BROKEN))


def weak_ending(marked: Column, low: Column, overlap: Column, number: Column, acts: Column, matters: Column) -> Column:
    """A sentence that ends a body without a fact: ``overlap`` is its count of words that are in the title, the rest whether
    it has a number, an act and a consequence."""
    heavy = matters & ~acts & (overlap <= 2) & (sum((low.contains(t).cast("int") for t in W.CONSEQUENCE), F.lit(0)) >= 2)
    vague = (starts(low, W.GENERIC_STARTS) & (F.length(marked) <= 150)) | heavy | low.rlike("|".join(W.WEAK_ENDINGS))
    return (marked != "") & ~number & vague


def template_body(c: Column | str, apart: bool = False) -> Column:
    """A body of stock phrases; an empty one is too. ``apart``: of "this this" only one counts, as the space between them
    can't end one and begin the other."""
    this = r"(?:^|[^a-z])this\s" if apart else r"(?<![a-z])this\s"
    stock = lambda low: sum((low.contains(p).cast("int") for p in W.GENERIC_PHRASES), F.lit(0))
    return let(F.lower(squeeze(c)), lambda low: (low == "") | (F.regexp_count(low, F.lit(this)) >= 2) | (stock(low) >= 2))


def title_hook(title: Column | str) -> Column:
    """A title of 4 to 14 words that acts, or has a figure, quote, colon, comma or question."""
    def hook(clean: Column) -> Column:
        low = F.lower(clean)
        lively = low.rlike(rf"\b(?:{'|'.join((*W.ACTION_VERBS, *W.HOOKS))})\b") | has_number(clean) | clean.rlike("[':,?]")
        return F.size(F.split(clean, " ")).between(4, 14) & ~low.rlike("^(?:the|a|an|in|on) ") & lively

    return let(squeeze(title), hook)


def body_hook(body: Column | str) -> Column:
    """A first sentence of 45 characters that acts or has a figure."""
    first = F.element_at(F.split(squeeze(body), r"(?<=[.!?])\s+"), 1)
    return let(first, lambda s: (F.length(s) >= 45) & (has_number(s) | F.lower(s).rlike(rf"\b(?:{'|'.join(W.ACTION_VERBS)})\b")))


# Grading a sentence, step by step: each takes the columns before it by name and gives those that it adds.


def _lowered(s) -> dict[str, Column]:
    return {"low": F.lower(s["text"])}


def _measured(s) -> dict[str, Column]:
    return {"words": style_tokens(s["low"]), "number": has_number(s["text"]), "acts": any_of(s["low"], W.ACTION_VERBS), "matters": any_of(s["low"], W.CONSEQUENCE)}


def _flagged(s) -> dict[str, Column]:
    return {"weak": weak_ending(*(s[n] for n in ("text", "low", "overlap", "number", "acts", "matters"))), "n": F.size(s["words"])}


def _scored(s) -> dict[str, Column]:
    points = lambda rule, n: F.when(rule, n).otherwise(0)
    base = (
        s["n"] + points(s["number"], 4) + points(any_of(s["low"], W.ONGOING), 3) + points(s["acts"], 2) + points(s["matters"], 2)
        - points(F.length(s["text"]) > 190, 2) - points(starts(s["low"], W.GENERIC_STARTS), 4) - points(s["low"].rlike(W.VAGUE_MOVE), 6) - points(s["weak"], 8)
        - points(s["overlap"] >= F.greatest(F.lit(4), F.least(s["n"], F.lit(6))), 8) - points(s["overlap"] >= F.greatest(F.lit(6), F.least(s["n"], F.lit(8))), 4)
    )
    return {"base": F.when(s["n"] == 0, -999).otherwise(base).cast("int"), "named": s["text"].rlike(r"\A[^ ]* (?:[^ ]* ){0,2}\p{Lu}")}


def graded(sentences: Column, title_tokens: Column) -> list[tuple[str, Column]]:
    """Columns to add one after the other, the last being `graded`: of each sentence of an array its text in plain marks,
    words, and scores. Steps are columns of their own so that each is worked out once.

    base: words that tell, 4 for a number, 3 for what goes on, 2 each for an act and a consequence, less for length, stock
    phrases, a weak ending and for repeating the title; -999 without words. The two points for standing first are left to
    the caller, who knows which sentences count."""
    def step(add, *held: str):
        return lambda s: F.struct(*(s[n].alias(n) for n in held), *(c.alias(n) for n, c in add(s).items()))

    held = ("text", "low", "words", "number", "acts", "matters")
    beside = lambda s, titles: F.struct(*(s[n].alias(n) for n in held), F.size(F.array_intersect(s["words"], titles)).alias("overlap"))
    return [
        ("_marked", F.transform(sentences, lambda s: F.struct(body_marks(s).alias("text")))),
        ("_lowered", F.transform("_marked", step(_lowered, "text"))),
        ("_measured", F.transform("_lowered", step(_measured, "text", "low"))),
        # the title's words stand beside each sentence: named within, they would be worked out for each
        ("_compared", F.zip_with("_measured", F.array_repeat(title_tokens, F.size("_measured")), beside)),
        ("_flagged", F.transform("_compared", step(_flagged, *held, "overlap"))),
        ("graded", F.transform("_flagged", step(_scored, "text", "words", "overlap", "number", "acts", "matters", "weak"))),
    ]
