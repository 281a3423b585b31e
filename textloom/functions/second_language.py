"""Copy in a second language: cleaning, fitting to a band of characters, and how much of the first language is left in it.

Columns in, columns out. Nulls count as empty. Copy is a card's text: ``fitted`` bounds it, whatever it is given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, share_in_range

# Words that are written in the second language, with what stands for them; words of the first that may stay;
# words of a source that aren't names though they begin with a capital; ends that close a text or make it longer.
REPLACED = {
    "restraint": "సంయమనం", "dialogue": "సంభాషణ", "tension": "ఉద్రిక్తత",
    "impact": "ప్రభావం", "escalation": "తీవ్రత పెరుగుదల",
}
KEPT = (
    "us", "uk", "un", "ai", "pm", "cm", "bjp", "congress", "g20", "who", "isro", "nato",
    "iran", "israel", "india", "modi", "trump", "rahul", "gandhi", "bbc", "rbi", "mea", "icc",
)
NOT_NAMES = (
    "the", "and", "for", "with", "from", "that", "this", "into", "after", "before", "over",
    "amid", "near", "more", "will", "have", "has", "had", "was", "were", "are", "is", "its",
    "their", "them", "they", "his", "her", "hers", "our", "your", "than", "then", "also",
    "said", "says", "say", "new", "old", "why", "what", "when", "where", "how", "all", "off",
    "out", "day", "days", "week", "weeks", "month", "months", "year", "years", "today", "soon",
    "public", "private", "sector", "government", "workers", "holiday", "break", "confirmed", "entry",
    "free", "best", "timings", "open", "opens", "story", "report", "live",
    "update", "updates", "news", "video", "photos", "amidst", "against", "through", "across",
)
CLOSURES = (" వివరాలు ఇంకా వెలుగులోకి వస్తున్నాయి.", " పరిస్థితిపై నిఘా కొనసాగుతోంది.")
TAILS = (
    " పరిణామాలపై నిఘా కొనసాగుతోంది.", " అధికారుల పర్యవేక్షణ కొనసాగుతోంది.", " తాజా వివరాలు ఇంకా వెలుగులోకి వస్తున్నాయి.",
    " దీనిపై స్పందనలు పెరుగుతున్నాయి.", " పరిస్థితి మార్పులపై దృష్టి నిలిచింది.", " సంబంధిత వర్గాలు అప్రమత్తంగా ఉన్నాయి.",
)
BAND, MOST_TAILS = (299, 350), 12
#: How far before the band's start a last sentence may end: when a long text is cut, and when a text breaks off.
CUT_SLACK, END_SLACK = 30, 25
STOPS = ".!?।"
LETTERS = (r"\x{C00}", r"\x{C7F}")
#: White space of any script.
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sanitised(c: Column | str) -> Column:
    """Single spaces, none before marks, straight quotes, listed words replaced."""
    c = F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE + "+", " "))
    c = F.regexp_replace(F.translate(c, "’“”", "'\"\""), rf" +([,.;:!?\x{{964}}])", "$1")
    for word, own in REPLACED.items():
        c = F.regexp_replace(c, rf"(?<![\p{{L}}\p{{N}}_])(?i:{word})(?![\p{{L}}\p{{N}}_])", own)
    return c


def title(c: Column | str) -> Column:
    """A title: commas become colons, marks go from its ends."""
    c = F.regexp_replace(F.regexp_replace(sanitised(c), r"\s*,\s*", ": "), r"\s*:\s*:\s*", ": ")
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" ,.-:"))


def _upto_stop(text: Column) -> Column:
    """The text up to its last stop; empty if it has none."""
    return F.regexp_extract(text, rf"(?s)^(.*[{STOPS}])", 1)


def _upto_space(text: Column, marks: str) -> Column:
    """The text before its last space, if something is there, without the marks at its end."""
    return F.rtrim(F.regexp_replace(text, r"(?s)(?<=.) [^ ]*$", ""), F.lit(marks))


def closed(c: Column | str, band: tuple[int, int] = BAND) -> Column:
    """The text ended by a stop: cut after its last one if that is late enough, else closed by a sentence that fits, else cut
    at a space."""

    def end(text: Column) -> Column:
        upto, n = _upto_stop(text), F.length(text)
        short = _upto_space(text, " ,:-")
        out = F.when((text == "") | text.rlike(rf"[{STOPS}]$"), text).when(F.length(upto) - 1 >= band[0] - END_SLACK, upto)
        for closure in CLOSURES:
            out = out.when(n + len(closure) <= band[1], F.concat(text, F.lit(closure)))
        return out.otherwise(F.when((short == "") | short.rlike(rf"[{STOPS}]$"), short).otherwise(F.concat(short, F.lit("."))))

    return let(F.rtrim(sanitised(c), F.lit(" ,:-")), end)


def padded(text: Column, band: tuple[int, int] = BAND) -> Column:
    """A text made longer by the tails in turn, until it reaches the band or the next one would leave it."""

    def add(t: Column) -> Column:
        # an empty text takes no space before the first tail
        n = F.when(t == "", -1).otherwise(F.length(t))
        upto, out = "", None
        for k in range(MOST_TAILS + 1):
            after = TAILS[k % len(TAILS)]
            full = (n + len(upto) >= band[0]) | (n + len(upto) + len(after) > band[1]) if k < MOST_TAILS else F.lit(True)
            longer = F.ltrim(F.concat(t, F.lit(upto)))
            out = F.when(full, longer) if out is None else out.when(full, longer)
            upto += after
        return out

    return let(text, add)


def fitted(c: Column | str, band: tuple[int, int] = BAND) -> Column:
    """A body within the band where that is possible, ended by a stop: a short one is padded, a long one cut at its last
    sentence, or at a space."""

    def start(text: Column) -> Column:
        clipped = F.left(text, F.lit(band[1]))
        upto = _upto_stop(clipped)
        cut = F.when(F.length(upto) - 1 >= band[0] - CUT_SLACK, upto).otherwise(_upto_space(clipped, " ,.-"))
        return F.when(F.length(text) <= band[1], padded(text, band)).otherwise(cut)

    return closed(padded(closed(let(sanitised(c), start), band), band), band)


def purity(c: Column | str) -> Column:
    """Percent of the characters, white space aside, that are of the second language."""
    return share_in_range(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE, ""), *LETTERS)


def kept_words(source_title: Column | str, source_body: Column | str) -> Column:
    """Words of the first language that may stay: listed ones, and the source's names."""
    source = F.concat(F.coalesce(col(source_title), F.lit("")), F.lit(" "), F.coalesce(col(source_body), F.lit("")))
    names = F.filter(F.regexp_extract_all(source, F.lit(r"[A-Za-z][A-Za-z'.-]+"), F.lit(0)), lambda t: t.rlike("^[A-Z]"))
    names = F.transform(names, lambda t: F.lower(F.btrim(t, F.lit("'.-"))))
    return F.array_union(F.array(*map(F.lit, KEPT)), F.filter(names, lambda t: (F.length(t) >= 2) & ~t.isin(*NOT_NAMES)))


def left_over(copy: Column | str, kept: Column) -> Column:
    """(words, share, found): how many words of the first language are in the copy that may not stay, their share of all
    words, and whether one of three letters or more is among them. The work is the copy's words times the kept ones."""
    text = F.coalesce(col(copy), F.lit(""))
    strange = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z]{2,}"), F.lit(0)), F.lower), lambda t: ~F.array_contains(kept, t))
    all_words = F.size(F.regexp_extract_all(text, F.lit(SPACE.replace("[", "[^", 1) + "+"), F.lit(0)))
    return let(strange, lambda s: F.struct(F.size(s).alias("words"), (F.size(s) / F.greatest(all_words, F.lit(1))).alias("share"), F.exists(s, lambda t: F.length(t) >= 3).alias("found")))
