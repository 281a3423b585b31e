r"""Personal data: fixed formats, and identifiers found by bootstrapping from their contexts. DataFrame functions only.

Base kinds are found by pattern, leftmost and not overlapping per kind; matches that fail their check (parts of an ip, Luhn,
numbers of digits) are dropped. The patterns here are possessive and start at the head of a run, which finds what the
plain ones find in one pass over any text. Offsets are code points: a text is split at its matches, and the lengths of what
lies between and of the matches add up.

The base entities are seeds. The two words before a seed are a pattern. Every identifier-shaped token (digits in it, of
some length) outside base spans is an instance of its own two words. Distinct (pattern, value) pairs make a graph. A
pattern's score is the share of known values among its values, if it has enough known ones; a value's score is one minus
the product of what its good patterns leave; values above the threshold become known and vouch for patterns in the next
round. Occurrences of found values are spans of kind ``id``. Graph tables have a row per distinct pair; aggregates are
combined before the shuffle, and patterns or values that very many rows share are joined by salt.

Null texts are empty; every row gives one row; equal rows repeat; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scope, Stored, salted_join

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match of the kind: cheaper than the pattern.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: Identifier-shaped tokens: at least this many characters and digits.
TOKEN = r"(?:\G|(?<![A-Za-z0-9_/+=-]))(?=[A-Za-z_/+=-]*[0-9])[A-Za-z0-9][A-Za-z0-9_/+=-]{6,}+"
MIN_DIGITS = 4
CONTEXT = r"(\S+\s+\S+)\s+\S{0,3}$"
#: Known values that a pattern needs, the score that makes it good, the score that makes a value known.
SUPPORT, GOOD_PATTERN, GOOD_VALUE = 3, 0.6, 0.65

CONTEXT_CHARS = 80

SPAN = "struct<first:int,last:int,value:string,before:string>"


#: Numbers that are added up at once; the sums of such runs are added up in turn, so that work grows with the text.
_RUN = 256


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once: a lambda binds it."""
    return F.transform(F.array(value), f)[0]


def _scan(numbers: Column, first: int, join) -> Column:
    """(total, before): all numbers joined, and those before each."""
    start = F.expr(f"struct({first} as total, cast(array() as array<int>) as before)")
    return F.aggregate(numbers, start, lambda s, x: F.struct(join(s["total"], x).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))


def _running(numbers: Column, first: int = 0, join=lambda a, b: a + b) -> Column:
    """For each number of one or more, those before it joined: their sum, if nothing else is said."""
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _RUN).cast("int")), lambda r: _scan(F.slice(n, r * _RUN + 1, F.lit(_RUN)), first, join))
    joined = lambda r: F.flatten(F.zip_with(r, _scan(F.transform(r, lambda x: x["total"]), first, join)["before"], lambda x, upto: F.transform(x["before"], lambda k: join(k, upto))))
    return _bound(numbers, lambda n: _bound(runs(n), joined))


def _outside(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps, in order. Both are sorted into one row of spans; one walk tells each token the
    last end of the base spans that start no later, one walk back the first start of the later ones."""
    far = 2**31 - 1
    spans = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["first"].alias("first"), F.lit(0).alias("token"), F.struct(b["last"].alias("last"), F.lit("").alias("value"), F.lit("").alias("before")).alias("s"))),
                                  F.transform(tokens, lambda t: F.struct(t["first"].alias("first"), F.lit(1).alias("token"), F.struct(t["last"].alias("last"), t["value"].alias("value"), t["before"].alias("before")).alias("s")))))

    def walked(all: Column) -> Column:
        ended = _running(F.transform(all, lambda x: F.when(x["token"] == 0, x["s"]["last"]).otherwise(0)), 0, F.greatest)
        starts = F.reverse(_running(F.reverse(F.transform(all, lambda x: F.when(x["token"] == 0, x["first"]).otherwise(far))), far, F.least))
        told = F.zip_with(all, F.arrays_zip(ended.alias("ended"), starts.alias("starts")), lambda x, w: F.struct(x.alias("x"), ((x["token"] == 1) & (w["ended"] <= x["first"]) & (w["starts"] >= x["s"]["last"])).alias("free")))
        return F.transform(F.filter(told, lambda t: t["free"]), lambda t: F.struct(t["x"]["first"].alias("first"), t["x"]["s"]["last"].alias("last"), t["x"]["s"]["value"].alias("value"), t["x"]["s"]["before"].alias("before")))

    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(_bound(spans, walked))


def _spans(text: Column, pattern: str, there: Column) -> Column:
    """All matches as (first, last, value, before); first and last are code points, last exclusive; before is some of the
    text that ends at the match."""
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(pair: Column) -> Column:
        f, b = pair["f"], pair["b"]
        upto = _running(F.zip_with(f, b, lambda v, x: F.coalesce(F.length(v), F.lit(0)) + F.length(x)))
        part = lambda a, k: F.coalesce(F.get(a, k), F.lit(""))
        before = lambda k: F.right(F.concat(part(b, k - 2), part(f, k - 2), part(b, k - 1), part(f, k - 1), part(b, k)), F.lit(CONTEXT_CHARS))
        spans = lambda u: F.transform(f, lambda v, k: F.struct((F.get(u, k) + F.length(F.get(b, k))).alias("first"), (F.get(u, k) + F.length(F.get(b, k)) + F.length(v)).alias("last"), v.alias("value"), before(k).alias("before")))
        return _bound(upto, spans)

    return F.when(there, _bound(F.struct(found.alias("f"), between.alias("b")), place)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, k: Column) -> Column:
        x = F.substring(digits, -k, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when(k % 2 == 1, x).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(13, 19), _luhn(v)).otherwise(F.lit(False)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _checked(kind: str):
    return lambda span: CHECKS[kind](span["value"])


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, a column of spans for each base kind, and ``seen``: (kind, first, last, value, context) of base
    spans and identifier-shaped tokens. One pass over the texts, no shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    there = {k: F.contains("text", F.lit(h)) for k, h in HINTS.items()} | {"card": F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){12}")}
    rows = rows.withColumns({k: _spans(F.col("text"), PATTERNS[k], there[k]) for k in KINDS} | {"token": _spans(F.col("text"), TOKEN, F.col("text").rlike("[0-9]"))})
    rows = rows.withColumns({k: F.filter(k, _checked(k)) for k in KINDS})
    base = F.concat(*KINDS)
    rows = rows.withColumn("base", base).withColumn("token", F.filter("token", lambda s: F.length(_digits(s["value"])) >= MIN_DIGITS))
    rows = rows.withColumn("token", _outside(F.col("token"), F.col("base")))

    def seen(column: str, known: bool) -> Column:
        return F.transform(column, lambda s: F.struct(F.lit(known).alias("known"), s["first"].alias("first"), s["last"].alias("last"), s["value"].alias("value"), F.lower(F.regexp_extract(s["before"], CONTEXT, 1)).alias("context")))

    return rows.select("doc_id", "row_key", *KINDS, F.concat(seen("base", True), seen("token", False)).alias("seen"))


def bootstrap(edges: DataFrame, scope: Scope | None = None) -> DataFrame:
    """(value) found: from distinct (context, value, known) pairs, by scoring patterns and values in turns until a round adds
    no value. Every other round adds one at least, so it ends."""
    known = Stored(edges.where("known").select("value").distinct().withColumn("found", F.lit(False)), "known")
    while True:
        marked = edges.select("context", "value").join(known.df, "value", "left")
        patterns = marked.groupBy("context").agg(F.count("*").alias("all"), F.count("found").alias("hits"))
        good = patterns.where((F.col("hits") >= SUPPORT) & (F.col("hits") >= GOOD_PATTERN * F.col("all"))).select("context", (F.col("hits") / (F.col("all") + 1)).alias("score"))
        scored = salted_join(marked.where("found is null").select("context", "value"), good, ["context"], "value", salts=16)
        fresh = scored.groupBy("value").agg(F.sum(F.log(1 - F.col("score"))).alias("left")).where(1 - F.exp("left") >= GOOD_VALUE)
        more = Stored(known.df.unionByName(fresh.select("value", F.lit(True).alias("found"))), "known")
        grown = more.df.where("found").count() > known.df.where("found").count()
        known.drop()
        known = more
        if not grown:
            if scope:
                scope.holds(known.path)
            return known.df.where("found").select("value")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: numbers of each base kind, the digest of base spans, and all spans as text."""
    with Scope(docs.sparkSession) as scope:
        rows = scope.store(found_spans(docs), "pii")
        # rows without an identifier take no part in the graph
        seen = rows.where(F.size("seen") > 0).select("row_key", F.inline("seen"))
        edges = scope.store(seen.where("context <> ''").groupBy("context", "value").agg(F.max("known").alias("known")), "pii-edges")
        values = bootstrap(edges, scope)
        found = salted_join(seen.where("not known").select("row_key", "first", "last", "value"), values, ["value"], "row_key", salts=16)
        added = found.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("added"))
        named = lambda c, kind: F.transform(c, lambda s: F.concat_ws(":", F.lit(kind), s["first"].cast("string"), s["last"].cast("string")))
        out = rows.join(added, "row_key", "left")
        base = F.array_join(F.concat(*(named(k, k) for k in KINDS)), ",")
        every = F.array_join(F.concat(*(named(k, k) for k in KINDS), F.coalesce(named("added", "id"), F.expr("cast(array() as array<string>)"))), ",")
        return scope.result(out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256"), every.alias("spans")), "pii-report")
