"""Queries over the desk, sentence, link, image and ranking rules, with their SQL.

The driver's texts are invented words, so articles here get a headline and a first sentence from a list, and listing pages
and picture addresses are made from templates: the same rows in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import desk_lexicons as D
from ..functions import lexicons as L
from ..functions import text as X
from ..operators import articles as A
from ..operators import desk as K
from ..operators import images as I
from ..operators import links as H
from ..operators import sentences as Z
from ..operators import stories as S
from . import tables as T
from .registry import query

HEADLINES = (
    "Chip Makers Raise Prices As Artificial Intelligence Demand Grows", "India Wins Cricket World Cup Final", "Assembly Elections In Bihar Draw Record Voter Turnout",
    "Bollywood Film Breaks Box Office Mark", "Bank Of Japan Holds Interest Rate", "Yoga And Diet Keep Patients Well", "Hyderabad Metro Opens New Line",
    "US Warns China Over Taiwan", "New Delhi Plans Cleaner Buses", "Strait Of Hormuz Closed To Tankers", "Gold Price Jumps In Mumbai", "Dubai Miracle Garden Offers Free Entry",
    "Court Hears Case Of Deportees", "Troops Leave Lebanon After Talks", "How To Watch The Eid Moon", "Andhra Pradesh Floods Cut Roads In Guntur", "Norway Storm Ingrid Shuts Schools",
)
OPENINGS = (
    "He said the F-16 and S-400 orders were reportedly late.", "Officials in Oslo closed 40 hospitals on Monday.", "It is a key waterway for oil.", "Images appear to show smoke, verified by two editors.",
    "The move could impact trade.", "They met in Geneva, Vienna and Rome in 2024.", "<b>Police</b> said nothing new <script>var d=1;</script> today.", "window.adUnit=1; The Senate voted.",
)
CLOSINGS = (
    "", " - Ends", " Published By: Some Editor", " Also Read | Another item", " Story continues below this ad and more", " Subscribe to India Today for more", " Follow us on every channel",
)
ANSWERS = ("International", "i think it is national.", "State", "no idea", "Sports", "")


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values, by: str) -> str:
    return f"list_extract([{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}], CAST(({by}) % {len(values)} AS INT) + 1)"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("article_id")
    rows = T.articles(spark, sf_dir)
    title = F.concat(_pick(HEADLINES, F.floor(i / 8)), F.lit(" "), (1000 + F.pmod(F.floor(i / 8), F.lit(9000))).cast("string"))
    body = F.concat(_pick(OPENINGS, i), F.lit(" "), "body", _pick(CLOSINGS, i))
    return rows.withColumns({"title": title, "body": body, "answer": _pick(ANSWERS, i)})


_ART = f"""{T.ARTICLES_SQL}, news AS (SELECT article_id, {_pick_sql(HEADLINES, 'article_id // 8')} || ' ' || (1000 + (article_id // 8) % 9000) AS title,
 {_pick_sql(OPENINGS, 'article_id')} || ' ' || body || {_pick_sql(CLOSINGS, 'article_id')} AS body, {_pick_sql(ANSWERS, 'article_id')} AS answer, url, source, source_url, category, event_s FROM art)"""


def _any_kw(x: str, keywords) -> str:
    single = "|".join(k for k in keywords if " " not in k)
    return "(" + " OR ".join([rf"regexp_matches({x}, '\b(?:{single})\b')"] + [f"contains({x}, '{k}')" for k in keywords if " " in k]) + ")"


def _in(x: str, values) -> str:
    return f"{x} IN ({T.quoted(values)})"


def _case(x: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


_HOME, _ABROAD = ("National", "State", "Finance", "Sports", "Entertainment", "Lifestyle"), ("International", "Technology", "Finance", "Sports", "Entertainment", "Lifestyle")
_DESK_SQL = f"""WITH {_ART},
d0 AS (SELECT *, {T.plain("lower(' ' || title || ' ' || body || ' ')")} AS x, lower(trim(source)) AS s, lower(category) AS hint, lower(url) AS addr, lower(source_url) AS section_url FROM news),
d1 AS (SELECT *, {_any_kw('x', D.TECH)} AS tech, {T.any_part('x', D.SPORTS_PARTS)} AS sports, {_any_kw('x', D.ELECTION)} AS election, {_any_kw('x', D.ENTERTAINMENT)} AS entertainment,
  {_any_kw('x', D.BUSINESS)} AS business, {_any_kw('x', D.LIFESTYLE)} AS lifestyle, {T.any_part('x', D.STATE)} AS state, {T.any_part('s', D.INDIA_SOURCES)} AS india_source,
  {T.any_part('s', D.INDIA_SOURCES)} OR {T.any_part('x', D.INDIA_PARTS)} AS india, {T.any_part('s', D.GLOBAL_SOURCES)} AS global_source, {T.any_part('x', D.FINAL_STATE_PARTS)} AS final_state,
  {T.any_part('x', D.FINAL_TECH_PARTS)} AS final_tech, {_case('hint', D.HINT_DESKS, 'NULL')} AS hinted,
  {T.any_part('x', D.FINAL_INDIA_PARTS)} OR contains(addr, '/india/') OR contains(addr, '/news/national/') OR ({T.any_part('s', D.FINAL_INDIA_SOURCES)} AND NOT ({T.any_part('section_url', D.WORLD_SECTIONS)} OR {T.any_part('addr', D.WORLD_SECTIONS)})) AS final_india FROM d0),
d2 AS (SELECT *, CASE WHEN tech THEN 'Technology' WHEN sports THEN 'Sports' WHEN election AND india THEN 'Assembly Elections' WHEN entertainment THEN 'Entertainment' WHEN business THEN 'Finance'
  WHEN lifestyle THEN 'Lifestyle' WHEN state THEN 'State' WHEN hinted = 'International' AND india THEN 'National' WHEN {_in('hinted', ('National', 'State'))} AND NOT india AND global_source THEN 'International'
  WHEN hinted IS NOT NULL THEN hinted WHEN india THEN 'National' ELSE 'International' END AS rules_desk,
  CASE {' '.join(f"WHEN contains(lower(trim(answer)), '{d.lower()}') THEN '{d}'" for d in D.DESKS)} END AS model FROM d1),
d3 AS (SELECT *, CASE WHEN model IS NULL THEN rules_desk WHEN hint = 'tech' OR tech THEN 'Technology' WHEN hint = 'business' OR business THEN 'Finance' WHEN hint = 'sports' THEN 'Sports'
  WHEN election AND india THEN 'Assembly Elections' WHEN state THEN 'State' WHEN india_source AND {_in('model', ('International', 'State'))} THEN CASE WHEN {_in('rules_desk', _HOME)} THEN rules_desk ELSE 'National' END
  WHEN NOT india AND {_in('model', ('National', 'State'))} THEN CASE WHEN {_in('rules_desk', _ABROAD)} THEN rules_desk ELSE 'International' END
  WHEN model = 'International' AND india THEN CASE WHEN {_in('rules_desk', ('National', 'State', 'Assembly Elections'))} THEN rules_desk ELSE 'National' END ELSE model END AS guarded_desk FROM d2)
SELECT article_id, rules_desk, guarded_desk, CASE WHEN hint = 'tech' OR final_tech THEN 'Technology' WHEN hint = 'sports' THEN 'Sports' WHEN hint = 'business' THEN 'Finance' WHEN final_state THEN 'State'
 WHEN hint = 'international' AND NOT final_india THEN 'International' WHEN final_india AND {_in('guarded_desk', ('International', 'State'))} THEN 'National' ELSE guarded_desk END AS desk FROM d3"""


@query(_DESK_SQL)
def desk_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.desks(articles(spark, sf_dir), F.col("answer")).select("article_id", "rules_desk", "guarded_desk", "desk")


_LABELS = (*D.DESKS, "Crime", "telangana", " Business ", "Weather", "")


@query(f"""WITH l AS (SELECT event_id, trim({_pick_sql(_LABELS, 'event_id')}) AS v FROM events)
SELECT event_id, CASE WHEN {_in('v', D.DESKS)} THEN v ELSE {_case('lower(v)', D.OLD_LABELS, "'National'")} END AS label FROM l""")
def desk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.events(spark, sf_dir).select("event_id", K.known_label(_pick(_LABELS, F.col("event_id"))).alias("label"))


_SOFT_TEXT = "lower(' ' || title || ' ' || url || ' ')"


@query(f"WITH {_ART} SELECT article_id, article_id % 4 <> 0 AND ({T.any_part(_SOFT_TEXT, D.SOFT_PARTS)} OR (category = 'international' AND {T.any_part(_SOFT_TEXT, D.SOFT_ABROAD)})) AS soft FROM news")
def low_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("article_id", K.low_signal(F.col("title"), F.col("url"), F.col("category"), F.col("article_id") % 4 != 0).alias("soft"))


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _clean_sql(x: str) -> str:
    x = T.collapse(x)
    for p in D.TAILS:
        x = f"trim(regexp_replace({x}, '(?is){_q(p)}', '', 'g'))"
    for p in D.SCRIPTS:
        x = f"regexp_replace({x}, '{_q(p)}', ' ', 'g')"
    return f"left({T.collapse(x)}, 5200)"


_CLEAN = f"{_ART}, clean AS (SELECT *, {_clean_sql('body')} AS prose FROM news)"


@query(f"WITH {_CLEAN} SELECT article_id, prose, length(prose) < 150 OR len(regexp_extract_all(prose, '[A-Za-z]{{3,}}')) < 20 AS thin FROM clean")
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("article_id", Z.clean_body("body").alias("prose"))
    return rows.select("article_id", "prose", Z.too_thin(F.col("prose")).alias("thin"))


_LEDE = rf"""CASE WHEN regexp_matches(s, '[0-9]') THEN 3 ELSE 0 END + least(len(regexp_extract_all({T.plain('s')}, '\b[A-Z][a-z]{{2,}}\b')), 3)
 - CASE WHEN regexp_matches({T.plain('s')}, '^\s*(?:He|She|It|They|His|Her|Its|Their|This|That)\b') THEN 2 ELSE 0 END"""
_SENTENCES = f"{_ART}, sent AS (SELECT article_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT article_id, {T.sentences('body')} AS l FROM news))"


@query(f"WITH {_SENTENCES} SELECT article_id, CAST(pos AS INT) AS pos, CAST({_LEDE} AS INT) AS score, ({' OR '.join(f'regexp_matches(lower(s), {chr(39)}{p}{chr(39)})' for p in D.LOW_VALUE_SENTENCES)}) AS low_value FROM sent")
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.exploded(articles(spark, sf_dir), X.sentences("body"), "pos", "s")
    return rows.select("article_id", "pos", Z.lede_score(F.col("s")).cast("int").alias("score"), Z.low_value(F.col("s")).alias("low_value"))


@query(f"WITH {_SENTENCES} SELECT article_id, arg_max(s, ({_LEDE}, -pos)) AS lede FROM sent GROUP BY 1")
def best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("article_id", Z.best_lede(F.col("body")).alias("lede")).where("lede is not null")


_FIRST = lambda x: f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"
_STYLE = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9''-]+'), lambda w: length(w) >= 3 AND w NOT IN ({T.quoted(D.STYLE_STOPWORDS)})))"


_OVERLAP = lambda a, b: f"len(list_intersect({a}, {b}))"


@query(f"""WITH {_ART}, ex AS (SELECT article_id AS example, {_STYLE("category || ' ' || source || ' ' || title || ' ' || body")} AS ts, {_STYLE('title')} AS tt, {_STYLE('source')} AS st FROM news WHERE article_id < 16),
own AS (SELECT article_id, {_STYLE("title || ' ' || left(body, 900)")} AS w FROM news),
o AS (SELECT article_id, example, 3 * {_OVERLAP('w', 'ts')} + 4 * {_OVERLAP('w', 'tt')} + {_OVERLAP('w', 'st')} AS score FROM own CROSS JOIN ex WHERE list_has_any(w, ts))
SELECT article_id, example, CAST(score AS INT) AS score, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, example) AS rank FROM o QUALIFY rank <= 3""")
def style_example_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three examples that are nearest each article in words; the first sixteen articles stand for the desk's examples."""
    rows = articles(spark, sf_dir)
    examples = rows.where("article_id < 16").select(F.col("article_id").alias("example"), F.concat_ws(" ", "category", "source", "title", "body").alias("text"), "title", F.col("source").alias("style"))
    return Z.style_examples(rows, examples).withColumn("rank", F.col("rank").cast("long"))


_TAIL_SQL = "CASE " + " ".join(f"WHEN {T.any_part('x', parts)} THEN '{_q(tail)}'" for parts, tail in D.CONTEXT_TAILS) + f" ELSE '{D.CONTEXT_OTHERWISE}' END"


@query(rf"""WITH {_ART}, x AS (SELECT *, lower(' ' || title || ' ' || body || ' ') AS x, {_FIRST(f"regexp_extract_all({T.plain('body')}, '" + chr(92) + "b[A-Z]{1,4}-[0-9]{1,4}[A-Z]?" + chr(92) + "b')")} AS d FROM news)
SELECT article_id, {_TAIL_SQL} AS tail, array_to_string(d, '|') AS designations FROM x""")
def context_and_designations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = Z.context_tail(F.col("title"), F.col("body"))
    return articles(spark, sf_dir).select("article_id", tail.alias("tail"), F.array_join(Z.designations("body"), "|").alias("designations"))


@query(f"""WITH {_ART}, t AS (SELECT *, list_filter(regexp_extract_all(lower(title || ' ' || title || ' ' || left(body, 320)), '[a-z0-9]{{4,}}'), lambda w: w NOT IN ({T.quoted((*L.TITLE_STOPWORDS, *D.PICTURE_WORDS))})) AS ws FROM news),
k AS (SELECT *, {_FIRST('ws')} AS ts FROM t)
SELECT article_id, CASE WHEN len(ts) > 0 THEN array_to_string(list_slice(ts, 1, 5), ' ') || ' ' || category || ' news photo' ELSE title || ' news photo' END AS query FROM k""")
def image_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("article_id", Z.image_query(F.lit(None).cast("string"), F.col("title"), F.col("body"), F.col("category")).alias("query"))


_TAG_LINES = ("#Breaking #breaking, #Tech", "", " , ", "##One two,THREE #one #four five six seven eight nine ten eleven", "news")


@query(f"""WITH k AS (SELECT event_id, list_filter(list_transform(regexp_split_to_array(trim({_pick_sql(_TAG_LINES, 'event_id')}), '[\\s,]+'), lambda t: regexp_replace(t, '^#+', '')), lambda t: t <> '') AS ws FROM events),
l AS (SELECT event_id, list_filter(ws, lambda w, i: list_position(list_transform(ws, lambda z: lower(z)), lower(w)) = i) AS ks FROM k)
SELECT event_id, CASE WHEN len(ks) = 0 THEN 'news' ELSE array_to_string(list_slice(ks, 1, 10), '|') END AS keywords FROM l""")
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.events(spark, sf_dir).select("event_id", F.array_join(Z.keyword_list(_pick(_TAG_LINES, F.col("event_id"))), "|").alias("keywords"))


# links of listing pages; {n} is the page's number
LISTING = (
    '<a href="/news/articles/c{n}x">a</a><a href="/news/world-europe-{n}1">b</a><a href="https://www.bbc.com/news/articles/c{n}y">c</a><a href="/news/live/x-{n}">d</a><a href="/news/articles/c{n}x">a</a>',
    '<a href="/india/a/articleshow/{n}.cms">e</a><a href="https://timesofindia.indiatimes.com/world/b/articleshow/{n}7.cms">f</a>',
    '<a href="/india/a/articleshow/{n}.cms">e</a><a href="/india/b/articleshow/{n}2.cms">e</a><a href="https://timesofindia.indiatimes.com/india/c/articleshow/{n}3.cms">f</a><a href="https://timesofindia.indiatimes.com/world/b/articleshow/{n}7.cms">g</a>',
    "<a href='https://www.ndtv.com/india-news/x-90000{n}?a=1&amp;b=2'>h</a><a href='//sports.ndtv.com/y-80000{n}'>i</a><a href='/video/z-70000{n}'>j</a><a href='latest/q-60000{n}'>k</a><a href='https://other.com/x-50000{n}'>l</a>",
    '<a href="/india/story/a-10000{n}-2024">m</a><a href="https://www.indiatoday.in/world/story/b-20000{n}">n</a><a href="/india/story/short-1">o</a><a href="/fact-check/story/c-30000{n}">p</a>',
    '<a href="https://www.reuters.com/world/asia/some-title-{n}-2024-01-02/">q</a><a href="/world/us/other-title-{n}">r</a><a href="/world/asia/x/deep-title-{n}">r2</a><a href="/world/china/item-IDABC{n}9">s</a><a href="/world/">t</a><a href="/markets/us/deals-{n}-x">u</a><a href="/video/world/v-ABCDEF{n}">v</a>',
    '<a href="/news/2024/1/{n}/none">w</a><a href="/news/2024/1/12/storm-{n}">w</a><a href="https://www.aljazeera.com/news/2024/11/2/quake-{n}">x</a><a href="/news/2024/1/12/storm-{n}">w</a>',
    '<a href="https://www.thehindu.com/news/national/a/article{n}.ece?x=1">y</a><a href="/news/national/b/article{n}.ece">z</a>', '<a href="/news/national/b/article{n}.ece">z</a><a href="/news/national/c/article{n}.ece">z</a>',
    '<a href="/world/2024/jan/02/a-{n}">1</a><a href="/sport/2023/dec/31/b-{n}">2</a><a href="https://www.theguardian.com/world/2024/feb/10/c-{n}">3</a><a href="/world/live/2024/feb/11/d">4</a><a href="/world/2024/Mar/1/e-{n}">5</a>',
    '<a href="/world/2022/may/3/1{n}">1</a><a href="/world/2024/may/3/2{n}">1</a><a href="/world/2023/may/3/3{n}">1</a><a href="/world/2024/jun/3/4{n}">1</a><a href="/world/2024/jun/13/5{n}">1</a><a href="/world/2024/jun/3/6{n}">1</a><a href="/sport/2025/jun/3/7{n}">1</a>',
)


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    three = [F.replace(_pick(LISTING, i + k), F.lit("{n}"), i.cast("string")) for k in range(3)]
    return T.table(spark, sf_dir, "pages").select("page_id", F.concat(*three, F.coalesce("html", F.lit(""))).alias("html"))


_LISTINGS = "pg AS (SELECT page_id, " + " || ".join(f"replace({_pick_sql(LISTING, f'page_id + {k}')}, '{{n}}', CAST(page_id AS VARCHAR))" for k in range(3)) + " || coalesce(html, '') AS html FROM pages)"


def _rule_sql(name: str, r: H.LinkRule, limit: int = 20) -> str:
    found = [f"regexp_extract_all(html, '(?i){_q(p)}', 1)" for p in r.patterns]
    found = found[0] if len(found) == 1 else f"list_concat({found[0]}, list_concat({found[1]}, {found[2] if len(found) > 2 else '[]'}))"
    if r.spare:
        found = f"CASE WHEN len({found}) < {r.enough} THEN list_concat({found}, regexp_extract_all(html, '(?i){_q(r.spare)}', 1)) ELSE {found} END"
    link = f"CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN '{r.base}' || h ELSE '{r.base}/' || h END"
    seen = r"lower(regexp_extract(u, '^[^/?#]*//[^/?#]*([^?#]*)', 1))" if r.by_path else "lower(u)"
    good = " AND ".join(["true"] + [f"regexp_matches(u, '{_q(p)}')" for p in r.must] + [f"NOT contains({seen}, '{p}')" for p in r.never])
    text = "trim(unnest(l))"
    for name_, mark in (*(X.ENTITIES[1:] if r.by_path else ()), X.ENTITIES[0]):
        text = f"replace({text}, '{name_}', '{_q(mark)}')"
    day = "CASE WHEN list_position([" + T.quoted(D.MONTHS) + "], regexp_extract(link, '/(\\d{4})/([a-z]{3})/(\\d{1,2})/', 2)) > 0 THEN CAST(regexp_extract(link, '/(\\d{4})/([a-z]{3})/(\\d{1,2})/', 1) AS BIGINT) * 10000 + 100 * list_position([" + T.quoted(D.MONTHS) + "], regexp_extract(link, '/(\\d{4})/([a-z]{3})/(\\d{1,2})/', 2)) + CAST(regexp_extract(link, '/(\\d{4})/([a-z]{3})/(\\d{1,2})/', 3) AS BIGINT) ELSE 0 END"
    order = f"{day} DESC, first" if r.newest_first else "first"
    inside = f"WHERE contains(link, '{r.section}') OR n_inside < 6" if r.section else ""
    return f"""SELECT page_id, '{name}' AS publisher, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS pos, link FROM (
 SELECT *, count(*) FILTER (contains(link, '{r.section or ''}')) OVER (PARTITION BY page_id) AS n_inside FROM (
 SELECT page_id, u AS link, min(k) AS first FROM (SELECT page_id, k, {link} AS u FROM (SELECT page_id, {text} AS h, generate_subscripts(l, 1) AS k FROM (SELECT page_id, {found} AS l FROM pg))) WHERE {good} GROUP BY 1, 2)) {inside} QUALIFY pos <= {limit}"""


@query(f"WITH {_LISTINGS} " + " UNION ALL ".join(_rule_sql(n, r) for n, r in H.RULES.items()))
def publisher_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.by_publisher(_listings(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


HEADS = (
    '<meta property="og:image" content="https://img.example.org/{n}.jpg"><script type="application/ld+json">{"datePublished": "2024-01-0{n}T10:00:00Z"}</script>',
    '<meta content="https://img.example.org/{n}.svg" property="og:image"><meta name="twitter:image" content="http://img.example.org/t{n}.png"><time datetime="2024-02-01">x</time>',
    '<script>{"image": "https://img.example.org/s{n}.png"}</script>', "<meta property='og:image' content='/relative/{n}.jpg'>", "",
)
_PICTURE_SQL = "coalesce(" + ", ".join(f"CASE WHEN starts_with(lower({u}), 'http') AND NOT ends_with(lower({u}), '.svg') THEN {u} END" for u in (f"trim(regexp_extract(html, '{_q(p)}', 1))" for p in H.PICTURE_PATTERNS)) + ")"


@query(f"""WITH pg AS (SELECT page_id, replace({_pick_sql(HEADS, 'page_id')}, '{{n}}', CAST(page_id AS VARCHAR)) || coalesce(html, '') AS html FROM pages)
SELECT page_id, coalesce({', '.join(f"nullif(trim(regexp_extract(html, '{_q(p)}', 1)), '')" for p in H.TIME_PATTERNS)}) AS published, {_PICTURE_SQL} AS picture FROM pg""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.replace(_pick(HEADS, F.col("page_id")), F.lit("{n}"), F.col("page_id").cast("string"))
    rows = T.table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.coalesce("html", F.lit(""))).alias("html"))
    return rows.select("page_id", H.published_time(F.col("html")).alias("published"), H.preview_picture(F.col("html")).alias("picture"))


@query(f"""WITH {_ART} SELECT article_id, CASE source {' '.join(f"WHEN '{s}' THEN length(t) >= {a} AND length(b) >= {c}" + (" AND p <> ''" if need else '') for s, (a, c, need) in D.LEAST.items())} ELSE false END AS fits
 FROM (SELECT article_id, source, left(title, 12 + article_id % 20) AS t, left(body, 50 + article_id % 90) AS b, CASE WHEN article_id % 3 = 0 THEN '' ELSE 'x' END AS p FROM news)""")
def source_minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("article_id").cast("int")
    title, body, picture = F.left("title", 12 + i % 20), F.left("body", 50 + i % 90), F.when(i % 3 == 0, "").otherwise("x")
    return articles(spark, sf_dir).select("article_id", H.long_enough(title, body, F.col("source"), picture).alias("fits"))


PICTURES = (
    "https://img.example.org/storm-norway-{n}.jpg", "https://img.example.org/logo{n}.png", "https://ichef.bbci.co.uk/news/1024/branded_news/{n}.jpg", "https://img.example.org/{n}.svg", "https://img.example.org/{n}.jpg?w=200",
    "https://img.example.org/{n}.jpg?resize=219,100", "https://img.example.org/{n}.jpg?resize=640,480&q=1", "https://img.example.org/{n}.jpg?overlay-x=1", "https://img.example.org/{n}.jpg?a=toi_sw", "https://b.scorecardresearch.com/{n}",
    "https://img.example.org/w=150,h=90/{n}.jpg", "https://img.example.org/chip-india-{n}.jpg?width=1200",
)
AROUND = ("Storm in Norway", "author profile", "", "India wins the cup final", "Hyderabad metro opens")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("article_id")
    places = (*D.PLACE_BONUS, "other")
    return articles(spark, sf_dir).select(
        "article_id", "title", "body", F.replace(_pick(PICTURES, i), F.lit("{n}"), i.cast("string")).alias("picture"), _pick(AROUND, i).alias("around"), _pick(places, i).alias("place"),
        (400 + i % 1700).cast("double").alias("width"), (300 + i % 900).cast("double").alias("height"), (i % 130).cast("double").alias("sharp"),
    )


_IMAGES = f"""{_ART}, im AS (SELECT article_id, title, body, replace({_pick_sql(PICTURES, 'article_id')}, '{{n}}', CAST(article_id AS VARCHAR)) AS picture, {_pick_sql(AROUND, 'article_id')} AS around,
 {_pick_sql((*D.PLACE_BONUS, 'other'), 'article_id')} AS place, CAST(400 + article_id % 1700 AS DOUBLE) AS width, CAST(300 + article_id % 900 AS DOUBLE) AS height, CAST(article_id % 130 AS DOUBLE) AS sharp FROM news),
i1 AS (SELECT *, lower(picture) AS low, regexp_extract(lower(picture), '^[^?#]*\\?([^#]*)', 1) AS asked, list_filter(regexp_extract_all(lower(title || ' ' || left(body, 500)), '[a-z0-9]{{4,}}'), lambda w: w NOT IN ({T.quoted(D.TOPIC_STOPWORDS)})) AS ws FROM im),
i2 AS (SELECT *, list_slice({_FIRST('ws')}, 1, 12) AS ts FROM i1),
i3 AS (SELECT *, contains(regexp_extract(low, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '{D.BLOCKED_HOSTS[0]}') OR ends_with(low, '.svg') OR {T.any_part('low', D.BLOCKED_PARTS)} OR regexp_matches(low, '{D.BLOCKED_SIZE}')
  OR regexp_matches(asked, '(?:^|&)[^=&]*(?:{'|'.join(D.BLOCKED_KEYS)})') OR regexp_matches(asked, '=[^&]*(?:{'|'.join(D.BLOCKED_VALUES)})')
  OR len(list_filter(regexp_extract_all(asked, '(?:^|&)(?:w|width|h|height|resize)=[^&0-9]*([0-9]+)', 1), lambda n: CAST(n AS DOUBLE) < 220)) > 0 AS blocked,
  CASE WHEN len(ts) = 0 THEN 0.1 ELSE greatest(0.0, least(1.0, 0.08 + len(list_filter(ts, lambda t: contains(low, t))) / len(ts) * 0.55 + len(list_filter(ts, lambda t: contains(lower(around), t))) / least(len(ts), 8) * 0.37
   - CASE WHEN {T.any_part('lower(around)', D.UNWANTED)} THEN 0.25 ELSE 0.0 END)) END AS fit FROM i2)"""


_BONUS_SQL = "CASE place " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.PLACE_BONUS.items()) + " ELSE 0.02 END"


@query(f"""WITH {_IMAGES} SELECT article_id, blocked, width >= 640 AND height >= 480 AS large, round(fit, 6) AS fit,
 round(CAST(least(1.5, width * height / (1920.0 * 1080.0)) * 0.48 + least(1.0, sharp / 100.0) * 0.22 + fit * 0.24 + {_BONUS_SQL} AS DOUBLE), 6) AS score FROM i3""")
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _images(spark, sf_dir).withColumn("fit", I.relevance(I.topic_terms(F.col("title"), F.col("body")), F.col("picture"), F.col("around"), D.UNWANTED))
    score = I.score(F.col("width"), F.col("height"), F.col("sharp"), F.col("fit"), F.col("place"))
    return rows.select("article_id", I.blocked(F.col("picture")).alias("blocked"), I.large_enough(F.col("width"), F.col("height")).alias("large"), F.round("fit", 6).alias("fit"), F.round(score, 6).alias("score"))


_REASONS = (*D.REASONS, "odd")


@query(f"""WITH r AS (SELECT user_id, list(DISTINCT {_pick_sql(_REASONS, 'event_id % 3 + user_id')} ORDER BY {_pick_sql(_REASONS, 'event_id % 3 + user_id')}) AS rs FROM events GROUP BY 1)
SELECT user_id, coalesce(list_filter([{T.quoted(D.REASONS)}], lambda x: list_contains(rs, x))[1], rs[1], 'download_failed') AS reason FROM r""")
def image_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = _pick(_REASONS, F.col("event_id") % 3 + F.col("run_id"))
    rows = T.events(spark, sf_dir).groupBy(F.col("run_id").alias("user_id")).agg(F.array_sort(F.collect_set(reason)).alias("rs"))
    return rows.select("user_id", I.main_reason(F.col("rs")).alias("reason"))


@query(f"WITH {_ART}, h AS (SELECT DISTINCT 'https://www.example.org/News/' || article_id AS seen FROM art WHERE article_id % 3 = 0) SELECT article_id FROM news WHERE 'https://www.example.org/News/' || article_id NOT IN (SELECT seen FROM h)")
def published_url_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third article was published under another spelling of its address; those are left out."""
    rows = articles(spark, sf_dir).withColumn("story_key", F.col("article_id").cast("string"))
    old = rows.where("article_id % 3 = 0").select(F.lit("none").alias("story_key"), F.concat(F.lit("https://www.example.org/News/"), "article_id", F.lit("?from=feed")).alias("url"), F.col("event_ts").alias("published_ts"))
    return S.unpublished(rows, old, F.timestamp_seconds(F.lit(T.START))).select("article_id")


@query(f"""WITH {_ART}, im AS (SELECT article_id, replace({_pick_sql(PICTURES, 'article_id')}, '{{n}}', CAST(article_id % 11 AS VARCHAR)) AS picture FROM news)
SELECT article_id, picture FROM im i WHERE article_id % 40 <> 0 AND NOT EXISTS (SELECT 1 FROM im u WHERE u.article_id % 40 = 0 AND u.picture = i.picture)""")
def unused_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose picture no published one used; every 40th was published, and pictures come again."""
    i = F.col("article_id")
    rows = articles(spark, sf_dir).select("article_id", F.replace(_pick(PICTURES, i), F.lit("{n}"), F.pmod(i, F.lit(11)).cast("string")).alias("picture"))
    return I.unused(rows.where("article_id % 40 <> 0"), rows.where("article_id % 40 = 0"))


_NAMES = f"""list_distinct(list_transform(list_filter(list_transform(string_split({T.collapse('title')}, ' '), lambda r: regexp_replace(r, '[^a-zA-Z0-9]', '', 'g')), lambda w: length(w) >= 2 AND regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN ({T.quoted(L.TITLE_STOPWORDS)})), lambda q: lower(q)))"""


@query(rf"""WITH {_ART}, n AS (SELECT article_id, {_NAMES} AS ns, regexp_extract_all({T.plain("title || ' ' || body")}, '\b[0-9]{{3,4}}\b') AS ds, regexp_extract_all({T.plain('title')}, '\b[0-9]{{3,4}}\b') AS ts FROM news)
SELECT a.article_id AS new_id, b.article_id AS old_id, CAST(len(list_intersect(a.ns, b.ns)) AS INT) AS shared FROM n a JOIN n b ON a.article_id > b.article_id AND list_has_any(a.ds, b.ts) AND len(list_intersect(a.ns, b.ns)) >= 2""")
def same_event_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that retell earlier ones, with each that they retell."""
    rows = articles(spark, sf_dir).select(F.col("article_id").alias("id"), "title", F.concat_ws(" ", "title", "body").alias("text"))
    return S.retold(rows, rows)


@query(f"""WITH {_ART}, n AS (SELECT article_id, {_NAMES} AS ns FROM news),
p AS (SELECT a.article_id AS new_id, b.article_id AS old_id, len(list_intersect(a.ns, b.ns)) AS shared FROM n a JOIN n b ON a.article_id % 50 = 0 AND a.article_id > b.article_id)
SELECT new_id, old_id, CAST(shared AS INT) AS shared, row_number() OVER (PARTITION BY new_id ORDER BY shared DESC, old_id) AS rank FROM p WHERE shared > 0 QUALIFY rank <= 30""")
def related_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search: the titles of ids divisible by 50 against all earlier ones, the 30 best of each."""
    rows = articles(spark, sf_dir).select(F.col("article_id").alias("id"), "title")
    return S.most_related(rows.where("id % 50 = 0"), rows).withColumn("rank", F.col("rank").cast("long"))


_CLUSTERS = f"""{_ART}, given AS (SELECT *, article_id // 6 AS cluster_id FROM news), roll AS (SELECT cluster_id, arg_max(title, (length(title), -article_id)) AS title FROM given GROUP BY 1)"""


@query(f"WITH {_CLUSTERS}, n AS (SELECT *, row_number() OVER (ORDER BY cluster_id) AS number FROM roll) SELECT cluster_id, number, left(sha1(number || ':' || {T.normalise('title')}), 12) AS key FROM n")
def cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = S.rollup(articles(spark, sf_dir).withColumn("cluster_id", F.floor(F.col("article_id") / 6)))
    return S.cluster_keys(rolled).select("cluster_id", F.col("number").cast("long").alias("number"), "key")


@query(f"""WITH {_ART}, p AS (SELECT article_id, article_id // 6 AS cluster_id, body, {T.keyword_count('low', L.PRIORITY_KEYWORDS['general'])} + 3 * (CASE category {' '.join(f"WHEN '{'tech' if c == 'technology' else c}' THEN {T.keyword_count('low', k)}" for c, k in L.PRIORITY_KEYWORDS.items() if c != 'general')} ELSE 0 END) AS priority
 FROM (SELECT *, ' ' || {T.plain("lower(title || ' ' || body || ' ' || url)")} || ' ' AS low FROM news))
SELECT article_id, cluster_id, CAST(priority AS INT) AS priority, row_number() OVER (PARTITION BY cluster_id ORDER BY priority DESC, length(body) DESC, article_id) AS rank FROM p""")
def order_within_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).withColumns({"cluster_id": F.floor(F.col("article_id") / 6), "priority": A.priority(F.concat_ws(" ", "title", "body", "url"), F.col("category"))})
    out = A.ranked(rows, [F.desc("priority"), F.desc(F.length("body")), F.asc("article_id")], "cluster_id")
    return out.select("article_id", "cluster_id", "priority", F.col("rank").cast("long").alias("rank"))


@query("""WITH c AS (SELECT event_id AS cluster_id, event_type AS category, event_id % 2 = 0 AS breaking, CAST(event_id % 7 AS INT) AS priority, CAST(event_id % 5 AS DOUBLE) / 5 AS confidence, epoch_us(ts) AS end_us, CAST(event_id % 3 AS INT) AS source_rank FROM events)
SELECT cluster_id, category, breaking, row_number() OVER (PARTITION BY category, breaking ORDER BY priority DESC, CASE WHEN breaking THEN confidence END DESC, end_us DESC, source_rank, cluster_id) AS rank FROM c""")
def pool_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = T.events(spark, sf_dir).select(
        i.alias("cluster_id"), F.col("event_type").alias("category"), (i % 2 == 0).alias("breaking"), (i % 7).cast("int").alias("priority"), ((i % 5).cast("double") / 5).alias("confidence"),
        F.col("ts").alias("end_ts"), (i % 3).cast("int").alias("source_rank"),
    )
    return S.pool_order(rows).select("cluster_id", "category", "breaking", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ART} SELECT greatest(15, (SELECT sum(greatest(0, t)) FROM (VALUES {', '.join(f'({n})' for _, n, _b in (*L.PLAN, ('none', -3, 0)))}) v(t))) AS most, count(*) AS candidates, count(*) FILTER (article_id % 4 = 0) AS n_breaking FROM news")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items a run may have (the larger of the setting and the plan), what stands by, and how many of it are breaking."""
    plan = spark.createDataFrame([(n,) for _, n, _b in (*L.PLAN, ("none", -3, 0))], "total int").agg(F.sum(F.greatest(F.lit(0), "total")).alias("planned"))
    counts = articles(spark, sf_dir).agg(F.count("*").alias("candidates"), F.count_if(F.col("article_id") % 4 == 0).alias("n_breaking"))
    # one row each
    return plan.crossJoin(counts).select(F.greatest(F.lit(15).cast("long"), "planned").alias("most"), "candidates", "n_breaking")
