"""Copy rules against plain Python versions of the rules."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textloom.functions import copy_lexicons as W
from textloom.functions import copyedit as E
from textloom.functions import text as X
from textloom.functions.desk_lexicons import STYLE_STOPWORDS
from textloom.operators import closeness as C
from textloom.operators import summary as S
from textloom.plans import copydesk


def column(spark, values, *exprs):
    """The expressions' values over a one-column table `v`."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[1] if len(exprs) == 1 else tuple(r)[1:] for r in rows.select("k", *[e.alias(f"e{n}") for n, e in enumerate(exprs)]).orderBy("k").collect()]


# plain versions, written from the rules


def marks(text):
    text = " ".join((text or "").split())
    for k, v in W.MARKS.items():
        text = text.replace(k, v)
    if not text:
        return text
    for pattern, other in ((r"\s+([,.;:!?])", r"\1"), (rf"(?i)\s*-\s*{W.PAPERS}\.?", "."), (rf"(?i)(?:\b{W.PAPERS}\b\.?\s*)+", ""), (r"\s+'", " '"), (r"'\s+", "' "), (r"\bUS\.(?=[-A-Z])", "US")):
        text = re.sub(pattern, other, text)
    return re.sub(r"\.\.+", ".", text if text[-1:] in (".", "!", "?") else text + ".")


def split(text):
    return [s for s in re.split(r"(?<=[.!?])\s+", " ".join((text or "").split())) if s]


def tokens(text):
    return {t for t in re.findall("[a-z0-9][a-z0-9'-]+", text.lower()) if len(t) >= 3 and t not in STYLE_STOPWORDS}


def shared(a, b):
    return len(tokens(a) & tokens(b))


def weak(sentence, title):
    s = marks(sentence)
    low = s.lower()
    if not s or re.search(r"\b[0-9]+\b", s):
        return False
    if any(re.search(p, low) for p in W.WEAK_ENDINGS) or (low.startswith(W.GENERIC_STARTS) and len(s) <= 150):
        return True
    return sum(t in low for t in W.CONSEQUENCE) >= 2 and shared(s, title) <= 2 and not any(t in low for t in W.ACTION_VERBS)


def quality(sentence, title, position):
    s = marks(sentence)
    low, n, over = s.lower(), len(tokens(s)), shared(s, title)
    if not n:
        return -999
    return (
        n + 4 * bool(re.search(r"\b[0-9]+\b", s)) + 3 * any(t in low for t in W.ONGOING) + 2 * any(t in low for t in W.ACTION_VERBS) + 2 * any(t in low for t in W.CONSEQUENCE) + 2 * (position <= 1)
        - 2 * (len(s) > 190) - 4 * low.startswith(W.GENERIC_STARTS) - 6 * bool(re.match(W.VAGUE_MOVE, low)) - 8 * weak(s, title) - 8 * (over >= max(4, min(n, 6))) - 4 * (over >= max(6, min(n, 8)))
    )


def repeats(sentence, others):
    s = marks(sentence)
    if not tokens(s):
        return True
    for o in map(marks, others):
        a, b = sorted((s.lower(), o.lower()), key=len)
        if a == b or (len(a) >= 40 and a in b) or SequenceMatcher(None, s.lower(), o.lower()).ratio() >= 0.86 or shared(s, o) >= max(4, min(len(tokens(s)), 6)):
            return True
    return False


def plain_chosen(title, body, target=320, most=360):
    everything = [marks(s) for s in split(body)]
    sentences = [s for s in everything if len(s) >= 35]
    score = {k: quality(s, title, k) for k, s in enumerate(sentences)}
    has = lambda s, parts: any(t in s.lower() for t in parts)
    taken = []
    for bonus in (lambda s: 3 * has(s, W.ACTION_VERBS), lambda s: 3 * bool(re.search(r"\b[0-9]+\b", s)), lambda s: 4 * has(s, W.CONSEQUENCE)):
        for _, s in sorted(((-(score[k] + bonus(s)), k), s) for k, s in enumerate(sentences)):
            if not repeats(s, taken) and len(" ".join([*taken, s])) <= most:
                taken.append(s)
                break
    where = {s: k for k, s in enumerate(sentences)}
    if len(taken) >= 3 and shared(taken[0], title) >= 4:
        options = []
        for k, s in enumerate(sentences):
            if s != taken[0] and not repeats(s, taken[1:]):
                new = sorted([*taken[1:], s], key=where.get)
                if len(" ".join(new)) <= most:
                    options.append((-(score[k] - 2 * shared(s, title) + 3 * has(s, W.CONSEQUENCE)), k, new))
        taken = min(options)[2] if options else taken
    if sentences:
        seen, more = list(taken), []
        for k, s in enumerate(everything):
            if len(s) >= 45 and not repeats(s, seen):
                more.append((-(quality(s, title, k) + any(w[:1].isupper() for w in s.split()[1:4])), len(more), s))
                seen.append(s)
        if not taken and len(more) < 2 and len(marks(title)) >= 35 and not repeats(title, seen):
            more.append((-5, len(more), marks(title)))
        for _, _, s in sorted(more):
            if not repeats(s, taken) and len(" ".join([*taken, s])) <= most:
                taken.append(s)
                if len(" ".join(taken)) >= target - 10 or len(taken) >= 4:
                    break
    if len(" ".join(taken)) > target:
        while len(taken) > 1 and weak(taken[-1], title):
            taken.pop()
    return taken


PARTS = (
    "Police in Oslo closed 40 hospitals on Monday after the storm", "The court will hear the case next week", "This development could impact regional dynamics", "Troops left Lebanon after talks with the US",
    "Officials said the strike could raise prices and risk jobs ahead", "Images appear to show smoke over the F-16 base", "Gold price jumps 3 percent in Mumbai as demand grows", "Gold price jumps in Mumbai as the demand grows 3 percent",
    "He said nothing", "Meanwhile talks continue in Geneva between the two sides", "The ministry of shipping launches a rescue operation off the coast with nine vessels and two helicopters, and the crew of the tanker was brought to safety by the navy late on Friday night, it said",
    "Analysts expect growth and investment to boost costs", "Schools will stay shut in Norway", "“Nobody” was hurt – said a nurse…", "The Times of India reported it", "It is a key waterway for oil and for the trade of the whole region",
)
TITLES = ("Gold price jumps in Mumbai as demand grows", "Court hears case", "", "Police in Oslo closed hospitals after storm", "Rescue operation off the coast saves the crew of a tanker")


def articles(n, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice(TITLES), " ".join(rng.choice(PARTS) + rng.choice((".", ".", "!", "?")) for _ in range(rng.choice((0, 1, 2, 4, 7, 12, 30))))) for k in range(n)]
    return [*rows, (n, None, None), (n + 1, "Only a title that is long enough to stand alone", "A sentence of fifty characters stands in the body here."), (n + 2, "x", "word " * 3000)]


FIELDS = "k long, title string, body string"


def test_marks_and_scores(spark):
    values = [*PARTS, *TITLES, None, " ", "a ' b' c", "ends..", "‘it’ is here ​", "US.-Iran", "BBC News. BBC News. Rain - Al Jazeera.", "été ."]
    assert column(spark, values, E.body_marks("v")) == [marks(v) for v in values]
    title = TITLES[0]
    rows = spark.createDataFrame([([s for s in values if s], title)], "s array<string>, title string").withColumn("w", E.style_tokens(F.lower("title")))
    for name, c in E.graded(F.col("s"), F.col("w")):
        rows = rows.withColumn(name, c)
    for r, s in zip(rows.first()["graded"], [s for s in values if s], strict=True):
        assert (r.text, r.base, r.weak, r.overlap) == (marks(s), quality(s, title, 9), weak(s, title), shared(marks(s), title))


def test_budgeted_sentences_are_the_plain_fold(spark):
    rows = articles(150)
    table = spark.createDataFrame([(*r, "own") for r in rows], FIELDS + ", words string")
    got = {r.k: r.picked for r in S.pick_sentences(table).collect()}
    assert got == {k: plain_chosen(t or "", (b or "")[:5200].strip()) for k, t, b in rows}
    assert any(len(x) == 4 for x in got.values()) and any(len(x) == 3 for x in got.values()) and all(len(" ".join(x)) <= 360 for x in got.values())


def test_replacing_a_first_sentence_that_repeats_the_title():
    grade = lambda s, t: {"text": marks(s), "words": tokens(marks(s)), "base": quality(s, t, 9), "overlap": shared(s, t), "number": bool(re.search(r"\b[0-9]+\b", s)), "acts": any(x in s.lower() for x in W.ACTION_VERBS), "matters": any(x in s.lower() for x in W.CONSEQUENCE), "weak": weak(s, t), "named": any(w[:1].isupper() for w in marks(s).split()[1:4])}
    rng, replaced = random.Random(5), 0
    for _ in range(400):
        title = rng.choice(TITLES)
        body = [rng.choice(PARTS) + "." for _ in range(rng.choice((3, 5, 9)))]
        want = plain_chosen(title, " ".join(body))
        assert S.chosen([grade(s, title) for s in split(" ".join(body))], marks(title)) == want
        replaced += len(want) >= 3 and shared(want[0], title) < 4
    assert replaced


def test_bounds_never_hide_a_close_pair(spark):
    rng = random.Random(2)
    values = [p + rng.choice(("", ".", " it said", " " + p)) for p in PARTS for _ in range(4)] + ["", "é" * 30, "a" * 300]
    pairs = [(a, b) for a in values for b in values]
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, a string, b string")
    rows = C.with_ratio(table, "a", "b", 0.8, "alike", opened="matched").orderBy("k").collect()
    assert [r.alike for r in rows] == [SequenceMatcher(None, a, b).ratio() >= 0.8 for a, b in pairs]
    assert sum(r.matched for r in rows) < 0.2 * len(rows)


def test_titles_too_close(spark):
    cases = [
        ("Gold Price Jumps!", "gold price jumps", True), ("One two three four five", "One two three four and more words", True), ("Court hears", "Court hears case of deportees", True), ("Oslo hospitals closed by police", "Police closed hospitals, Oslo", True),
        ("Storm shuts schools", "Bank holds rates", False), ("Tankers strandeds", "Tanker strande", True), ("", "Title", False), (None, None, False), ("!!", "!!", False), ("The of to", "As in on", False),
    ]
    got = C.titles_too_close(spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string"), "a", "b").orderBy("k").collect()
    assert [r.too_close for r in got] == [c[2] for c in cases]


def test_bodies_that_share_a_whole_sentence_are_settled_without_matching(spark):
    """A sentence taken as it is settles its row: nothing is joined, shuffled or sent to Python for it."""
    held = "The ministry launched a rescue operation off the coast."
    table = spark.createDataFrame([(k, f"Help came. {held} More {k}.", f"{held} Nine vessels were sent on Friday night.") for k in range(5)] + [(None, held, held), (9, "Short one.", "Short one."), (10, held.upper(), held)], "k int, body string, src string")
    out = C.bodies_too_close(table, "k", "body", "src")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert [r.too_close for r in out.collect()] == [True] * 8
    assert out.columns == ["k", "body", "src", "too_close"]


def test_sentences_are_matched_where_a_bound_leaves_them_open(spark):
    rng = random.Random(7)
    def spoiled(s):
        return "".join(rng.choice("abcdefghij ") if rng.random() < 0.1 else c for c in s)
    rows = []
    for k in range(60):
        source = [rng.choice(PARTS) + "." for _ in range(4)]
        rows.append((k, [spoiled(s) for s in rng.sample(source, 2)] + [None], source + [None]))
    got = C.sentence_matches(spark.createDataFrame(rows, "k int, a array<string>, b array<string>"), "a", "b").orderBy("k").collect()
    want = [any(len(s) >= 40 and SequenceMatcher(None, s, t).ratio() >= 0.86 for s in a if s for t in b if t) for _, a, b in rows]
    assert [r.lifted for r in got] == want and 0 < sum(want) < len(want)


def test_bodies_too_close(spark):
    source = "The ministry launched a rescue operation off the coast. Nine vessels were sent on Friday night. The crew was brought home."
    cases = [
        ("Help came. Nine vessels were sent on Friday nights to the place.", False), ("Help came. The ministry launched a rescue operation off the coasts.", True), (source + " End.", True), ("Short one. Tiny.", False), (None, False), ("", False),
    ]
    got = C.bodies_too_close(spark.createDataFrame([(k, c[0], source) for k, c in enumerate(cases)], "k int, body string, src string"), "k", "body", "src").orderBy("k").collect()
    want = []
    for body, _ in cases:
        a, b = split(body), split(source)
        near = SequenceMatcher(None, " ".join((body or "").split()).lower(), source.lower()).ratio() >= 0.8
        want.append(bool(a) and (near or any(len(marks(s)) >= 40 and SequenceMatcher(None, marks(s).lower(), marks(t).lower()).ratio() >= 0.86 for s in a for t in b)))
    assert [r.too_close for r in got] == want == [c[1] for c in cases]


def test_titles_in_house_style(spark):
    assert column(spark, ["Gold falls | BBC", "Rain - Live Updates", "A -  Times of India ", None, " | "], E.without_noise("v")) == ["Gold falls", "Rain", "A", "", ""]
    assert column(spark, ["u.s. and U. K. talk", "Rs 5, r s", "US. Army", "US-iran deal", None], E.acronyms("v")) == ["US. and UK. talk", "Rs 5, Rs", "US Army", "US-Iran deal", ""]
    assert column(spark, ["war , widens now", "“A” – b ?", None], E.title_marks("v")) == ["war: widens now", '"A" - b?', ""]
    assert column(spark, ["a, b ,c", "x: : y,", None], E.without_commas("v")) == ["a b c", "x: y", ""]
    assert column(spark, ["the us and nato: talks", "x:y: Z", "", None, "élan: ärger"], E.sentence_case("v")) == ["The US and NATO: Talks", "X: Y: Z", "", "", "Élan: ärger"]
    assert column(spark, ["the end of THE war", "isro and u.s. in (NATO)", "", "un"], E.title_case("v")) == ["The End of THE War", "ISRO and U.S. in (NATO)", "", "UN"]
    long = "word " * 30
    got = column(spark, [long, "x" * 100, "ab " + "y" * 76 + " zz", "short", None], E.cut_title("v"))
    assert got == [("word " * 16).strip(), "x" * 80, "ab " + "y" * 76, "short", ""]


def plain_names(text, title, body):
    spelled = {}
    for sentence in split(f"{title or ''} {body or ''}"):
        for raw in sentence.split()[1:]:
            word = re.sub("[^A-Za-z'’-]", "", raw)
            if len(word) >= 3 and not word.isupper() and word[0].isupper():
                spelled[word.lower()] = word
    for name in W.PROPER_NOUNS:
        spelled.setdefault(name, name[:1].upper() + name[1:])
    for low, name in spelled.items():
        text = re.sub(rf"(?i)\b{re.escape(low)}\b", name, text)
    return text


def test_names_as_the_source_has_them(spark):
    rows = [
        ("police in oslo meet o'brien and mcDonald", "Police in Oslo", "Later O'Brien met McDonald. Oslo slept. The Police's man"), ("al-qaeda men and qaeda", "Men of Al-Qaeda", "Say Qaeda's al-QAEDA"), ("india and usa in UAE", "x", None),
        ("Paper setters are here", "Paper setters are kept", "Setters stay."), ("", "A Big One", "It Is"), ("naïve école", "The École Naïve", "x Naïve"), ("big and BIG", "a Big", "a BIG bIg Big bigger"), ("iPhone maker", "The iPhone", "An IPhone"),
    ]
    table = spark.createDataFrame(rows, "v string, title string, body string").coalesce(1)
    got = [r[0] for r in table.select(E.restore_names("v", E.source_names("title", "body"))).collect()]
    assert got == [plain_names(*r) for r in rows]


def test_designations_and_first_acronyms(spark):
    rows = [("the f16 and s 400 or F-16a", "F-16 and S-400 fly", "An F-16A too"), ("an f-16", None, None), (None, "F-16", "")]
    table = spark.createDataFrame(rows, "v string, title string, body string").coalesce(1)
    assert [r[0] for r in table.select(E.restore_designations("v", E.source_designations("title", "body"))).collect()] == ["the F-16 and S-400 or F-16A", "an f-16", ""]
    rows = [("The United Nations met. United Nations left.", "UN meets", ""), ("The United Nations (UN) met", "un", ""), ("The prime minister and Prime Minister", "", "PM said"), ("United Nations", "Unrest", "")]
    table = spark.createDataFrame(rows, "v string, title string, body string").coalesce(1)
    got = [r[0] for r in table.select(E.first_acronyms("v", "title", "body")).collect()]
    assert got == ["The United Nations (UN) met. United Nations left.", "The United Nations (UN) met", "The prime minister (PM) and Prime Minister", "United Nations"]


@pytest.mark.parametrize("cut, text", [
    (True, "The government responded to."), (True, "The initiative is set to expand its."), (True, "Passengers should monitor updates for the."), (True, "Officials warned residents and."), (True, "They are looking for the."),
    (False, "The economy grew at 7.2% in Q3."), (False, "Over 100 flights were cancelled across India."), (True, "They charged it with cross-border."), (False, "He was the runner-up."), (True, "The bus stands, a move."), (True, "It said that UN."),
    (True, "The rise comes as the."), (False, ""), (True, "Talks are ongoing."), (False, "It is a twenty-year-old."),
])
def test_cut_ends(spark, cut, text):
    assert column(spark, [text], E.unfinished("v")) == [cut]
    assert bool(re.search("|".join(W.UNFINISHED), text.lower())) == cut


def test_band_and_completion(spark):
    three = "First sentence here. Second sentence follows. Third sentence is longer and exceeds the limit set for display."
    assert column(spark, [three, "word " * 40, "a" * 90, None], S.band(X.sentences("v"), 50)) == ["First sentence here. Second sentence follows.", ("word " * 10).strip(), "a" * 50, ""]
    whole = "The navy brought the whole crew to safety on Friday night. "
    values = [whole + "The army spoke to all of the many people there and charged Islamabad with cross-border.", whole + "They went to the.", whole, ""]
    assert column(spark, values, S.completed(F.col("v"), 60)) == [whole + "The army spoke to all of the many people there.", whole.strip(), whole, ""]


def test_cards(spark):
    rows = articles(120, 7)
    table = spark.createDataFrame([(*r, "own") for r in rows], FIELDS + ", card string")
    got = S.cards(table).collect()
    made = [r for r in got if r.card_title is not None]
    assert got[0].asDict().keys() == {"k", "title", "body", "card", "card_title", "card_body"} and len(got) == len(rows) and len(made) > 20
    for r in got:
        assert (r.card_title is None) == (r.card_body is None)
    for r in made:
        assert 16 <= len(r.card_title) <= 80 and 230 <= len(r.card_body) <= 360 and "," not in r.card_title
        assert r.card_body[-1] in ".!?" and not re.search("|".join(W.UNFINISHED), r.card_body.lower())
        sentences = split(r.card_body)
        assert len({s.lower() for s in sentences}) == len(sentences)


def test_doubt_and_proof(spark):
    values = ["The clip was not independently verified by the agency.", "Images circulating online show a fire.", "BBC Verify checked it.", "A video seems viral here", "Rain fell.", None]
    rows = column(spark, values, S.needs_caution(F.lit(""), F.col("v")), S.has_proof(F.lit(""), F.col("v")))
    assert rows == [(True, False), (True, False), (False, True), (True, False), (False, False), (False, False)]


def test_stock_words_side_by_side(spark):
    """As SQL counts them, of two that share a space one counts; elsewhere each one does."""
    rows = spark.createDataFrame([("so this this is it",), ("this is so, this is it",), ("Athis this is",)], "body string")
    got = rows.select(E.template_body("body", apart=True).alias("apart"), E.template_body("body").alias("each")).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, True), (False, False)]


def test_marks_of_odd_pieces(spark):
    rng = random.Random(11)
    pieces = (*W.MARKS, "a", "B", "é", " ", "  ", "\t", "\n", "　", "\u0085", " ", ".", "..", "!", "?", ",", "'", " '", "-", "US.", "US.-", "x US.A", "India Today", "times of India", "BBC News", "AlJazeera", "al jazeera", "The Times of India", "U.S.", "9")
    values = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) + rng.choice(("", ".", " word.")) for _ in range(1500)]
    # a text of zero-width marks alone is not empty here, and becomes a full stop
    values = [v for v in values if marks(v)]
    assert column(spark, values, E.body_marks("v")) == [marks(v) for v in values]


def test_numbers_and_parts_are_told_as_before(spark):
    values = ["a 12 b", "F16", "16F", "x-16", "1_2", "_1", "1,2", "é1", "a1 2", "12", "", None]
    old = column(spark, values, F.col("v").rlike(r"\b[0-9]+\b"))
    assert column(spark, values, E.has_number(F.col("v"))) == old and True in old and False in old
    assert column(spark, ["hit", "hits", "hi", "", None], E.any_of(F.col("v"), ("hits", "hit", "hit"))) == [True, True, False, False, None]
    words = ["ab abc a-b a-bc 'abc ab' x9z the a", ""]
    assert column(spark, words, E.style_tokens(F.col("v"))) == [["abc", "a-b", "a-bc", "ab'", "x9z"], []]


def test_sentences_are_graded_once_and_rows_of_arrays_are_whole(spark):
    plan = copydesk.sentence_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("broader tensions") == 1
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None)], "k long, v array<string>")
    assert [tuple(r) for r in X.exploded(rows, "v", "pos", "s", keep="k").orderBy("pos").collect()] == [(1, 0, "a"), (1, 1, None), (1, 2, "b")]


def test_only_sentences_whose_turn_comes_are_compared(monkeypatch):
    """Of many sentences that tell different things the best are taken, and the others aren't held against each other."""
    rng, compared = random.Random(1), []
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(9)).capitalize() + "." for _ in range(60)]
    rows = [{"text": s, "words": tokens(s), "base": k % 17, "overlap": 0, "number": False, "acts": False, "matters": False, "weak": False, "named": False} for k, s in enumerate(texts)]
    name = "like" if hasattr(S.Pick, "like") else "_like"
    held = getattr(S.Pick, name)
    monkeypatch.setattr(S.Pick, name, lambda *a: compared.append(1) or held(*a))
    assert len(S.chosen(rows, "A title")) == 4
    assert len(compared) < 400
