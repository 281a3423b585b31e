"""The registered queries over the library's own operators, with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import articles as A
from ..operators import pages as P
from ..operators import run_machine as M
from ..operators import runs as R
from ..operators import stories as S
from . import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "breaking_stories"
#: "Now" of all queries: the time after the last article or event is a parameter, never the clock.
NOW_DOCS = 1704067200 + 420 * 1000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"SELECT doc_id, {T.normalise('text')} AS norm FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", X.normalise("text").alias("norm"))


_TOKENS = f"t AS (SELECT doc_id, {T.salient('text')} AS tokens FROM documents)"


@query(f"WITH {_TOKENS} SELECT doc_id, unnest(tokens) AS token, CAST(generate_subscripts(tokens, 1) - 1 AS INT) AS pos FROM t")
def tokenize_salient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exploded(T.table(spark, sf_dir, "documents"), X.salient("text"), "pos", "token", keep="doc_id")


@query(f"WITH {_TOKENS} SELECT doc_id, bigram, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS bigram FROM t) GROUP BY ALL")
def token_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.table(spark, sf_dir, "documents").select("doc_id", X.salient("text").alias("tokens"))
    return X.exploded(tokens, X.bigrams(F.col("tokens")), "bigram", keep="doc_id").groupBy("doc_id", "bigram").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {T.lead('text')} AS lead FROM documents")
def lead_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", X.lead("text").alias("lead"))


@query(f"SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos FROM (SELECT doc_id, {T.sentences('text')} AS s FROM documents)")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exploded(T.table(spark, sf_dir, "documents"), X.sentences("text"), "pos", "sentence", keep="doc_id")


# a lexicon of words that the tables have, beside the categories' own
_LEXICONS = L.CATEGORY_KEYWORDS | {"common": ("the", "of", "with", "des", "una", "und der", "of the", "que el")}


@query(" UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, CAST({T.keyword_count(T.plain('lower(text)'), k)} AS INT) AS score FROM documents" for c, k in _LEXICONS.items()))
def keyword_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    scores = F.array(*(F.struct(F.lit(c).alias("category"), X.keyword_count(low, k).alias("score")) for c, k in _LEXICONS.items()))
    return T.table(spark, sf_dir, "documents").select("doc_id", F.inline(scores))


_REASON = f"""CASE WHEN length({T.collapse('title')}) < 16 THEN 'title_short' WHEN length({T.collapse('body')}) < 120 THEN 'body_short'
 WHEN {T.any_part("lower(" + T.collapse('title') + " || ' ' || " + T.collapse('body') + ")", L.IRRELEVANT)} THEN 'irrelevant'
 WHEN {T.any_part('lower(url)', L.LOW_VALUE_URLS)} THEN 'low_value_url'
 WHEN {T.any_part("lower(" + T.collapse('title') + " || ' ' || " + T.collapse('body') + ")", L.LOW_VALUE_TITLES)} THEN 'low_value_title' END"""


@query(f"WITH {T.ARTICLES_SQL} SELECT article_id, {_REASON} AS reason FROM art")
def content_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("article_id", A.relevance_reason(F.col("title"), F.col("body"), F.col("url")).alias("reason"))


@query(f"WITH {T.ARTICLES_SQL} SELECT coalesce({_REASON}, 'passed') AS reason, count(*) AS n FROM art GROUP BY 1")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = A.relevance_reason(F.col("title"), F.col("body"), F.col("url"))
    return T.articles(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


_ANY = lambda x, keys: f"({T.keyword_count(x, keys)} > 0)"
_CATEGORY_SQL = f"""WITH {T.ARTICLES_SQL},
f AS (SELECT *, {_REASON} IS NULL AS relevant, {T.plain("lower(title || ' ' || body)")} AS c, {T.plain("lower(title || ' ' || body || ' ' || url)")} AS e, lower(source) AS s, lower(source_url) AS u FROM art),
g AS (SELECT *, {T.any_part('s', L.INTERNATIONAL_SOURCES)} AS abroad_source, {T.any_part('s', L.INDIA_SOURCES)} AS india_source,
  {T.any_part('e', L.INDIA_MARKERS)} AS india, {T.any_part('e', L.LOCAL_POLITICS)} AS local_,
  ({_ANY('e', L.INTERNATIONAL_MARKERS)} OR ({_ANY('e', ['us'])} AND {_ANY('e', ['israel'])})) AS abroad FROM f),
h AS (SELECT *, CASE WHEN {T.any_part('u', L.SOURCE_HINTS['national'])} AND NOT abroad THEN false WHEN india AND NOT abroad AND NOT abroad_source THEN false WHEN abroad THEN true
   WHEN ({T.any_part('u', L.SOURCE_HINTS['international'])} OR abroad_source) AND NOT (india AND local_) THEN true ELSE {_ANY('c', L.CATEGORY_KEYWORDS['international'])} END AS international,
  CASE WHEN {T.any_part('u', L.SOURCE_HINTS['national'])} THEN CASE WHEN abroad AND NOT local_ THEN false ELSE india OR {_ANY('e', L.CATEGORY_KEYWORDS['national'])} END
   WHEN india_source OR india THEN NOT (abroad AND NOT local_) ELSE {_ANY('c', L.CATEGORY_KEYWORDS['national'])} END AS national,
  ({T.any_part('u', L.SOURCE_HINTS['politics'])} AND {T.keyword_count('c', L.CATEGORY_KEYWORDS['politics'])} > 0) OR {T.keyword_count('c', L.CATEGORY_KEYWORDS['politics'])} >= 2 OR {_ANY('c', L.POLITICS_STRONG)} AS politics,
  {_ANY('c', L.CATEGORY_KEYWORDS['business'])} AS business, {_ANY('c', L.CATEGORY_KEYWORDS['tech'])} AS tech, {_ANY('c', L.CATEGORY_KEYWORDS['sports'])} AS sports FROM g)
""" + " UNION ALL ".join(f"SELECT article_id, '{c}' AS category FROM h WHERE relevant AND {c}" for c in L.CATEGORY_KEYWORDS)


@query(_CATEGORY_SQL)
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.categorised(T.articles(spark, sf_dir).drop("category")).select("article_id", "category")


_RANK_SQL = """CASE WHEN contains(lower(source), 'toi') OR contains(lower(source), 'times of india') OR contains(lower(source), 'india today') THEN 0
 WHEN contains(lower(source), 'aljazeera') THEN 1 WHEN contains(lower(source), 'bbc') THEN 2 WHEN contains(lower(source), 'ndtv') THEN 5 ELSE 4 END"""


def _own_priority(low: str) -> str:
    return "CASE category " + " ".join(f"WHEN '{'tech' if c == 'technology' else c}' THEN {T.keyword_count(low, k)}" for c, k in L.PRIORITY_KEYWORDS.items() if c != "general") + " ELSE 0 END"


_PRIORITY_SQL = f"""{T.ARTICLES_SQL}, pr AS (SELECT *, {_RANK_SQL} AS source_rank, {T.keyword_count('low', L.PRIORITY_KEYWORDS['general'])} + 3 * ({_own_priority('low')}) AS priority
 FROM (SELECT *, ' ' || {T.plain("lower(title || ' ' || body || ' ' || url)")} || ' ' AS low FROM art))"""


def _prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.articles(spark, sf_dir)
    return rows.withColumns({"priority": A.priority(F.concat_ws(" ", "title", "body", "url"), F.col("category")), "source_rank": A.source_rank(F.col("source"))})


@query(f"WITH {_PRIORITY_SQL} SELECT article_id, source, category, CAST(priority AS INT) AS priority, CAST(source_rank AS INT) AS source_rank, row_number() OVER (PARTITION BY source ORDER BY priority DESC, event_s DESC, source_rank, article_id) AS rank FROM pr QUALIFY rank <= 5")
def priority_topn_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [F.desc("priority"), F.desc("event_ts"), F.asc("source_rank"), F.asc("article_id")]
    return A.ranked(_prioritised(spark, sf_dir), by, "source").where("rank <= 5").select("article_id", "source", "category", "priority", "source_rank", F.col("rank").cast("long").alias("rank"))


_PLAN_SQL = "plan(category, pos, total, target) AS (VALUES " + ", ".join(f"('{c}', {k}, {n}, {b})" for k, (c, n, b) in enumerate(L.PLAN)) + ")"


@query(
    f"""WITH {_PRIORITY_SQL}, {_PLAN_SQL},
pool AS (SELECT article_id, category, priority > 0 AS breaking, row_number() OVER (PARTITION BY category, priority > 0 ORDER BY priority DESC, event_s DESC, article_id) AS rank FROM pr),
a AS (SELECT *, count(*) FILTER (breaking) OVER w AS nb, count(*) FILTER (NOT breaking) OVER w AS nn FROM pool JOIN plan USING (category) WHERE rank <= total WINDOW w AS (PARTITION BY category)),
b AS (SELECT *, least(target, nb, total) AS fb, least(least(target, total) - least(target, nb, total), nn) AS fn FROM a),
c AS (SELECT *, CASE WHEN breaking AND rank <= fb THEN rank WHEN NOT breaking THEN fb + rank ELSE nn + rank END AS turn FROM b)
SELECT article_id, category, breaking, rank, turn, breaking OR rank <= fn AS as_breaking, row_number() OVER (ORDER BY pos, turn) AS slot FROM c WHERE turn <= total QUALIFY slot <= 30"""
)
def quota_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prioritised(spark, sf_dir).withColumn("breaking", F.col("priority") > 0).withColumn("pool", F.concat_ws("/", "category", F.col("breaking").cast("string")))
    pools = A.ranked(rows, [F.desc("priority"), F.desc("event_ts"), F.asc("article_id")], "pool").select("article_id", "category", "breaking", F.col("rank").cast("long").alias("rank"))
    plan = spark.createDataFrame([(c, k, n, b) for k, (c, n, b) in enumerate(L.PLAN)], "category string, pos int, total int, target int")
    return A.quota_plan(pools, plan, 30).select("article_id", "category", "breaking", "rank", F.col("turn").cast("long").alias("turn"), "as_breaking", F.col("slot").cast("long").alias("slot"))


_URL_SQL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$'"


@query(
    f"""WITH u AS (SELECT page_id, trim(url) AS raw, regexp_replace(regexp_extract(trim(url), {_URL_SQL}, 3), ';[^/]*$', '') AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(raw, {_URL_SQL}) THEN lower(regexp_extract(raw, {_URL_SQL}, 1)) || '://' || lower(regexp_extract(raw, {_URL_SQL}, 2)) || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END ELSE raw END AS url FROM u"""
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", X.normalise_url("url").alias("url"))


@query(
    r"""WITH l AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]+)"', 1) AS h FROM pages)),
m AS (SELECT page_id, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href ELSE href END AS link, min(pos) AS first FROM l GROUP BY 1, 2)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY first) AS pos FROM m QUALIFY pos <= 20"""
)
def links_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.links(T.table(spark, sf_dir, "pages")).withColumn("pos", F.col("pos").cast("long"))


def _decoded(x: str) -> str:
    for name, mark in (*X.ENTITIES[1:], X.ENTITIES[0], ("\\n", " "), ("\\u0027", "'"), ('\\"', '"')):
        x = f"replace({x}, '{name}', '{mark.replace(chr(39), chr(39) * 2)}')"
    return T.collapse(x)


_TITLE_SQL = "coalesce(" + ", ".join(f"CASE WHEN length({t}) > 12 THEN {t} END" for t in (_decoded(f"regexp_extract(html, '{p.replace(chr(39), chr(39) * 2)}', 1)") for p in P.TITLE_PATTERNS)) + ")"


@query(f"SELECT page_id, {_TITLE_SQL} AS title FROM pages")
def extract_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", P.title(F.col("html")).alias("title"))


_PARAGRAPHS_SQL = rf"""list_filter(list_transform(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda p: {_decoded("regexp_replace(p, '<[^>]+>', ' ', 'g')")}),
 lambda t: length(t) > 24 AND NOT {T.any_part('lower(t)', P.NOT_BODY)})"""


@query(f"SELECT page_id, CASE WHEN len(p) > 0 THEN array_to_string(list_slice(p, 1, 10), ' ') END AS body, CAST(len(p) AS INT) AS n_paragraphs FROM (SELECT page_id, {_PARAGRAPHS_SQL} AS p FROM pages)")
def extract_paragraph_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", P.body(F.col("html")).alias("body"), F.size(P.paragraphs(F.col("html"))).alias("n_paragraphs"))


@query("SELECT sha1(text) AS text_sha1, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").select(F.sha1("text").alias("text_sha1"), "doc_id", "source")
    return rows.groupBy("text_sha1").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("n_sources")).where("n > 1")


_KEY_SQL = f"""{T.ARTICLES_SQL}, k0 AS (SELECT *, {T.lead('body')} AS lead FROM art),
k1 AS (SELECT *, list_slice(list_sort(list_distinct({T.entities('title')})), 1, 8) AS p0, list_sort(list_distinct(list_filter({T.salient('title')}, lambda t: t NOT IN ({T.quoted(L.KEY_GENERIC)})))) AS tt,
  list_sort(list_distinct({T.salient('lead')})) AS lt, list_sort({T.numbers("title || ' ' || lead")}) AS nums FROM k0),
k2 AS (SELECT *, CASE WHEN len(p0) < 3 THEN list_slice(list_concat(p0, list_filter(tt, lambda t: NOT list_contains(p0, t))), 1, 10) ELSE p0 END AS p1 FROM k1),
k3 AS (SELECT *, CASE WHEN len(p1) < 4 THEN list_slice(list_concat(p1, list_filter(lt, lambda t: NOT list_contains(p1, t))), 1, 12) ELSE p1 END AS p2 FROM k2),
k4 AS (SELECT *, list_concat(p2, list_filter(nums, lambda t: NOT list_contains(p2, t))) AS p3 FROM k3),
keyed AS (SELECT *, left(sha1(CASE WHEN len(p3) = 0 THEN {T.normalise('title')} ELSE array_to_string(p3, '|') END), 16) AS story_key FROM k4)"""


@query(f"WITH {_KEY_SQL} SELECT article_id, story_key FROM keyed")
def story_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.articles(spark, sf_dir).withColumn("lead", X.lead("body"))
    return rows.select("article_id", X.story_key(F.col("title"), F.col("lead")).alias("story_key"))


_REP_SQL = _KEY_SQL.replace("FROM art),\nk1", "FROM art), rep AS (SELECT * FROM k0 QUALIFY row_number() OVER (PARTITION BY article_id // 6 ORDER BY length(title) DESC, length(lead) DESC, length(body) DESC, article_id) = 1),\nk1").replace("AS nums FROM k0)", "AS nums FROM rep)")


@query(f"WITH {_REP_SQL} SELECT article_id // 6 AS cluster_id, article_id, story_key FROM keyed")
def cluster_story_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each cluster's representative."""
    return S.story_keys(T.articles(spark, sf_dir).withColumn("cluster_id", F.floor(F.col("article_id") / 6)))


@query(f"WITH {T.ARTICLES_SQL} SELECT article_id // 6 AS cluster_id, source, count(*) AS n_articles, min(article_id) AS first_id, max(event_s) AS last_s FROM art GROUP BY ALL")
def cluster_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.source_groups(T.articles(spark, sf_dir).withColumn("cluster_id", F.floor(F.col("article_id") / 6)))
    return rows.select("cluster_id", "source", "n_articles", "first_id", F.unix_timestamp("last_ts").alias("last_s"))


_BIGRAMS = lambda t: f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
_FEATURES_SQL = f"""{T.ARTICLES_SQL}, f0 AS (SELECT article_id, event_s, title, body, {T.lead('body')} AS lead FROM art),
f1 AS (SELECT *, {T.salient('title')} AS t, {T.salient('lead')} AS l FROM f0),
ft AS MATERIALIZED (SELECT article_id, event_s, list_distinct({T.words(T.normalise('body'))}) AS bs, list_distinct(t) AS ts, list_distinct(l) AS ls,
  list_distinct(list_concat(list_concat(t, l), list_concat({_BIGRAMS('t')}, {_BIGRAMS('l')}))) AS ss, {T.numbers("title || ' ' || lead")} AS ns FROM f1),
met AS MATERIALIZED (SELECT a.article_id AS a, b.article_id AS b FROM (SELECT article_id, event_s, unnest([event_s // 7200 - 1, event_s // 7200, event_s // 7200 + 1]) AS k FROM ft) a
  JOIN ft b ON b.event_s // 7200 = a.k AND a.article_id < b.article_id AND abs(a.event_s - b.event_s) <= 7200),
pairs AS MATERIALIZED (SELECT a.article_id AS a, b.article_id AS b, {T.jaccard('a.bs', 'b.bs')} AS content, {T.jaccard('a.ts', 'b.ts')} AS title, {T.jaccard('a.ls', 'b.ls')} AS lead, {T.jaccard('a.ss', 'b.ss')} AS story,
  (len(a.ns) = 0 OR len(b.ns) = 0 OR list_has_any(a.ns, b.ns)) AS fits
  FROM met m JOIN ft a ON a.article_id = m.a JOIN ft b ON b.article_id = m.b),
scored AS (SELECT *, CASE WHEN title >= 0.52 AND (lead >= 0.22 OR content >= 0.45 * 0.7) AND fits THEN greatest(title, story, content) WHEN lead >= 0.38 AND story >= 0.30 AND fits THEN greatest(lead, story)
  WHEN story >= 0.42 AND lead >= 0.24 AND fits THEN greatest(story, lead) WHEN content >= 0.55 AND fits THEN content ELSE 0.0 END AS score FROM pairs)"""
_KEEP = ["title_norm", "title_count", "body_set", "title_set", "lead_set", "story_set", "number_set"]


def _pairs(spark: SparkSession, sf_dir: str, with_ratio: bool) -> DataFrame:
    pairs = S.window_pairs(S.features(T.articles(spark, sf_dir)), 120, _KEEP)
    rows = S.pair_score(pairs, with_ratio=with_ratio, all_overlaps=not with_ratio)
    return rows.withColumns({"a": F.least("a_article_id", "b_article_id"), "b": F.greatest("a_article_id", "b_article_id")})


@query(f"WITH {_FEATURES_SQL} SELECT a, b, round(content, 6) AS content, round(title, 6) AS title, round(lead, 6) AS lead, round(story, 6) AS story, fits FROM scored WHERE content > 0.3 OR story > 0.2")
def jaccard_pairs_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, False).where("content > 0.3 or story > 0.2")
    return rows.select("a", "b", *(F.round(c, 6).alias(c) for c in ("content", "title", "lead", "story")), "fits")


@query(f"WITH {_FEATURES_SQL} SELECT a, b, round(score, 6) AS score FROM scored WHERE score > 0")
def pair_score_without_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, False).where("score > 0").select("a", "b", F.round("score", 6).alias("score"))


@query()
def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, True).where("score > 0").select("a", "b", F.round("score", 6).alias("score"))


@query()
def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clusters(T.articles(spark, sf_dir))


@query()
def breaking_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles to stories to breaking decisions, end to end."""
    rows = T.articles(spark, sf_dir)
    members = rows.join(S.clusters(rows), "article_id")
    return S.breaking(S.rollup(members)).select("cluster_id", "category", "n_articles", "n_sources", "title", "confidence", "is_breaking", "reasons")


# stories given by a rule, so that SQL can follow: six articles in a row
_GIVEN = f"""{T.ARTICLES_SQL}, given AS (SELECT *, article_id // 6 AS cluster_id FROM art),
roll AS (SELECT cluster_id, min(event_s) AS start_s, max(event_s) AS end_s, count(*) AS n_articles, arg_max(title, (length(title), -article_id)) AS title, list_sort(list_distinct(list(source))) AS sources FROM given GROUP BY 1),
main AS (SELECT cluster_id, category, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(article_id)) AS k FROM given GROUP BY cluster_id, category)"""


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rollup(T.articles(spark, sf_dir).withColumn("cluster_id", F.floor(F.col("article_id") / 6)))


@query(f"WITH {_GIVEN} SELECT cluster_id, start_s, end_s, n_articles, title, array_to_string(sources, '|') AS sources, category FROM roll JOIN main USING (cluster_id) WHERE k = 1")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, sf_dir).select("cluster_id", F.unix_timestamp("start_ts").alias("start_s"), F.unix_timestamp("end_ts").alias("end_s"), "n_articles", "title", F.array_join("sources", "|").alias("sources"), "category")


_WEIGHT = "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.CREDIBILITY.items()) + " ELSE 0.4 END"
_MINUTES = 45


@query(
    f"""WITH {_GIVEN}, w AS (SELECT cluster_id, (end_s - start_s) / 60.0 AS span, len(sources) AS n, list_transform(sources, lambda s: CAST({_WEIGHT} AS DOUBLE)) AS ws FROM roll),
v AS (SELECT *, list_sum(ws) / n AS avg_w, len(list_filter(ws, lambda x: x >= 0.85)) AS high FROM w),
c AS (SELECT *, round(avg_w * 0.5 + least(1.0, n / 3.0) * 0.35 + greatest(0.0, 1 - span / {_MINUTES}.0) * 0.15, 4) AS confidence FROM v)
SELECT cluster_id, CAST(n AS INT) AS n_sources, confidence, CAST(n < 3 AS INT) + CAST(span > {_MINUTES} AS INT) + CAST(avg_w < 0.7 AS INT) + CAST(high < 1 AS INT) + CAST(confidence < 0.6 AS INT) AS n_reasons,
  n >= 3 AND span <= {_MINUTES} AND avg_w >= 0.7 AND high >= 1 AND confidence >= 0.6 AS is_breaking FROM c"""
)
def breaking_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.breaking(_given(spark, sf_dir), min_sources=3, minutes=_MINUTES)
    return rows.select("cluster_id", "n_sources", "confidence", F.size("reasons").alias("n_reasons"), "is_breaking")


def _stem_sql(w: str) -> str:
    cases = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) - {len(s)} >= 3 THEN left({w}, length({w}) - {len(s)}) || '{o}'" for s, o in L.STEM_SUFFIXES)
    return f"CASE WHEN length({w}) <= 4 THEN {w} {cases} ELSE {w} END"


_TITLES_SQL = f"""{T.ARTICLES_SQL}, tw AS (SELECT article_id, list_distinct(list_transform(list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}'), lambda w: w NOT IN ({T.quoted(L.TITLE_STOPWORDS)})), lambda z: {_stem_sql('z')})) AS ws,
  list_distinct(list_transform(list_filter(list_transform(string_split({T.collapse('title')}, ' '), lambda r: regexp_replace(r, '[^a-zA-Z0-9]', '', 'g')), lambda w: length(w) >= 2 AND regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN ({T.quoted(L.TITLE_STOPWORDS)})), lambda q: lower(q))) AS ns FROM art),
tp AS (SELECT a.article_id AS new_id, b.article_id AS old_id, {T.jaccard('a.ws', 'b.ws')} AS word_sim, {T.jaccard('a.ns', 'b.ns')} AS name_sim, len(list_intersect(a.ns, b.ns)) AS shared
  FROM tw a JOIN tw b ON a.article_id > b.article_id AND len(a.ws) >= 2 AND len(b.ws) >= 2)"""


@query(f"WITH {_TITLES_SQL} SELECT new_id, old_id, round(word_sim, 6) AS word_sim, round(name_sim, 6) AS name_sim, CAST(shared AS INT) AS shared FROM tp WHERE (shared >= 2 AND name_sim >= 0.5 AND word_sim >= 0.25) OR word_sim >= 0.62 OR (CASE WHEN name_sim > 0 THEN word_sim * 0.4 + name_sim * 0.6 ELSE word_sim END) >= 0.5")
def title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title against all earlier ones."""
    found = S.similar_titles_within(T.articles(spark, sf_dir).select(F.col("article_id").alias("id"), "title"))
    return found.select("new_id", "old_id", F.round("word_sim", 6).alias("word_sim"), F.round("name_sim", 6).alias("name_sim"), "shared")


@query(f"WITH {_KEY_SQL}, h AS (SELECT * FROM keyed WHERE article_id % 3 = 0) SELECT article_id, story_key FROM keyed k WHERE article_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.story_key = k.story_key AND h.event_s >= {NOW_DOCS} - 172800) AND NOT EXISTS (SELECT 1 FROM h WHERE h.url = k.url)")
def history_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the articles are the history of what was published, the others are held against it."""
    rows = T.articles(spark, sf_dir).withColumn("story_key", X.story_key(F.col("title"), X.lead("body")))
    history = rows.where("article_id % 3 = 0").select("story_key", "url", F.col("event_ts").alias("published_ts"))
    return S.unpublished(rows.where("article_id % 3 <> 0"), history, F.timestamp_seconds(F.lit(NOW_DOCS))).select("article_id", "story_key")


@query("SELECT user_id AS run_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def history_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(T.events(spark, sf_dir), ["run_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("run_id", "event_type", "event_id", "value")


@query(f"WITH {T.ARTICLES_SQL} SELECT category, count(*) AS n, count(DISTINCT source) AS n_sources FROM art GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


@query(
    f"""WITH {T.ARTICLES_SQL}, h AS (SELECT article_id, category, list_slice(list_filter(regexp_extract_all(lower(title), '[a-zA-Z]{{4,}}'), lambda w: w NOT IN ({T.quoted(L.TITLE_STOPWORDS)})), 1, 1000) AS ws FROM art),
d AS (SELECT *, list_slice(list_filter(ws, lambda w, i: list_position(ws, w) = i), 1, 3) AS k FROM h)
SELECT article_id, left(array_to_string(list_concat([CASE WHEN category = 'sports' THEN '#trending' ELSE '#breaking' END], list_concat(['#' || category], list_filter(list_transform(k, lambda w: '#' || w), lambda t: t <> '#' || category))), ' '), 120) AS hashtags FROM d"""
)
def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("article_id", X.hashtags(F.col("category"), F.col("title"), F.lit(True)).alias("hashtags"))


@query(
    f"""WITH {T.ARTICLES_SQL}, v AS (SELECT article_id, category, title, {T.lead('body')} AS body FROM art)
SELECT article_id, CASE WHEN length(title) < 10 THEN 'title_short' WHEN length(title) > 80 THEN 'title_long' WHEN contains(title, ',') THEN 'title_comma' WHEN contains(title, '!') THEN 'title_exclamation'
 WHEN length(body) < 50 THEN 'body_short' WHEN length(body) > 380 THEN 'body_long' WHEN regexp_matches(lower({T.collapse('body')}), '(\\bthe\\s+times\\s+of\\s+india|times\\s+of\\s+india|india\\s+today|bbc\\s+news|al\\s*jazeera)\\b') THEN 'body_boilerplate'
 WHEN category NOT IN ('international', 'national', 'politics', 'business', 'tech') THEN 'category' WHEN article_id % 5 = 0 THEN 'image' END AS error FROM v""".replace("\\\\", "\\")
)
def validate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.articles(spark, sf_dir).withColumn("body", X.lead("body"))
    error = A.validation_error(F.col("title"), F.col("body"), F.col("category"), T.CATEGORIES[:5], F.col("article_id") % 5 != 0)
    return rows.select("article_id", error.alias("error"))


@query("SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS last_event, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS last_us, count(*) AS n_events FROM events GROUP BY 1")
def run_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.latest_state(T.events(spark, sf_dir))
    return rows.select("run_id", "last_event", F.unix_micros("started_ts").alias("started_us"), F.unix_micros("last_ts").alias("last_us"), "n_events")


# event types stand for statuses here
_STATUS = {"click": "queued", "view": "running", "purchase": "stopping"}


@query(
    f"""WITH l AS (SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS last_event, max(ts) AS last_ts FROM events GROUP BY 1),
s AS (SELECT run_id, CASE last_event {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS status, last_ts FROM l)
SELECT run_id, status FROM s WHERE epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', last_ts)) > CASE status WHEN 'queued' THEN 180 WHEN 'stopping' THEN 30 WHEN 'running' THEN 900 END"""
)
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.events(spark, sf_dir)
    status = F.element_at(F.create_map(*(F.lit(x) for p in _STATUS.items() for x in p)), F.col("last_event"))
    now = events.agg(F.max("ts").alias("now"))
    # one row: the parameter "now" of this query
    states = R.latest_state(events).withColumn("status", status).join(F.broadcast(now))
    return R.stale(states, F.col("now")).select("run_id", "status")


#: What the driver's event types stand for, and how many consecutive events make a run.
_ACTIONS = {"signup": "queue", "view": "claim", "click": "step", "error": "stop", "purchase": "finish"}
_PER_RUN = 7


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, ts, event_id, action."""
    action = F.element_at(F.create_map(*(F.lit(x) for p in _ACTIONS.items() for x in p)), F.col("event_type"))
    # the first event of a run puts it in the queue
    action = F.when(F.col("event_id") % _PER_RUN == 0, "queue").otherwise(action)
    return T.events(spark, sf_dir).select(F.floor(F.col("event_id") / _PER_RUN).alias("run_id"), "ts", "event_id", action.alias("action"))


_LIMIT = "CASE status " + " ".join(f"WHEN '{k}' THEN {v * 1_000_000}" for k, v in R.STALE_SECONDS.items()) + " END"
_MOVED = "CASE " + " ".join(f"WHEN action = '{a}' AND now = '{s}' THEN '{t}'" for a, m in M.MOVES.items() for s, t in m.items()) + " ELSE now END"


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id // {_PER_RUN} AS run_id, epoch_us(ts) AS us, CASE WHEN event_id % {_PER_RUN} = 0 THEN 'queue' ELSE CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTIONS.items())} END END AS action,
 row_number() OVER (PARTITION BY event_id // {_PER_RUN} ORDER BY ts, event_id) AS k FROM events),
walk AS (
  SELECT run_id, 0::BIGINT AS k, 'none' AS status, NULL::BIGINT AS last, NULL::BIGINT AS ended, false AS stale FROM (SELECT DISTINCT run_id FROM e)
  UNION ALL
  SELECT run_id, k, CASE WHEN quiet THEN 'cancelled' ELSE {_MOVED} END, us, CASE WHEN quiet THEN last + lim WHEN ended IS NULL AND {_MOVED} IN ({T.quoted(M.FINAL)}) THEN us ELSE ended END, stale OR quiet
  FROM (SELECT w.run_id, e.k, w.status AS now, w.last, w.ended, w.stale, e.us, e.action, {_LIMIT.replace('status', 'w.status')} AS lim, coalesce(e.us - w.last >= {_LIMIT.replace('status', 'w.status')}, false) AS quiet
        FROM walk w JOIN e ON e.run_id = w.run_id AND e.k = w.k + 1)),
l AS (SELECT *, {_LIMIT} AS lim, (SELECT max(epoch_us(ts)) FROM events) - last >= {_LIMIT} AS quiet FROM walk QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k DESC) = 1)
SELECT run_id, CASE WHEN quiet THEN 'cancelled' ELSE status END AS status, CASE WHEN quiet THEN last + lim ELSE ended END AS ended_us, stale OR coalesce(quiet, false) AS stale FROM l"""
)
def run_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each run ended, silence included, at the time of the last event."""
    now = T.events(spark, sf_dir).agg(F.max("ts")).first()[0]
    return M.histories(run_events(spark, sf_dir), F.lit(now)).select("run_id", "status", F.unix_micros("ended_ts").alias("ended_us"), "stale")


@query("SELECT event_id, user_id AS run_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS step FROM events")
def step_payload_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.events(spark, sf_dir).select("event_id", "run_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("step"))


@query(
    r"""SELECT doc_id, CASE WHEN length(s) = 0 THEN 0.0 ELSE round(100.0 * length(regexp_replace(s, '[^\x{C0}-\x{24F}]', '', 'g')) / length(s), 6) END AS percent
FROM (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS s FROM documents)"""
)
def script_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a range of letters in each text; here accented Latin ones."""
    return T.table(spark, sf_dir, "documents").select("doc_id", F.round(X.share_in_range(F.col("text"), r"\x{C0}", r"\x{24F}"), 6).alias("percent"))


@query(
    f"""WITH s AS (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, {T.sentences('text')} AS x FROM documents)),
r AS (SELECT *, sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS upto FROM s)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS trimmed FROM r WHERE upto <= 360 GROUP BY 1"""
)
def trim_to_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sentences from the start as long as they fit; a fold over the sentences, no shuffle."""
    found = X.sentences("text")
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def add(state, s):
        longer = F.when(state["text"] == "", s).otherwise(F.concat(state["text"], F.lit(" "), s))
        fits = state["open"] & (F.length(longer) <= 360)
        return F.struct(F.when(fits, longer).otherwise(state["text"]).alias("text"), fits.alias("open"))

    out = F.aggregate(found, start, add, lambda s: s["text"])
    return T.table(spark, sf_dir, "documents").select("doc_id", out.alias("trimmed")).where("trimmed <> ''")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 60 MINUTES, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def hourly_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed stream."""
    rows = T.events(spark, sf_dir).groupBy(F.window("ts", "60 minutes"), "event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", F.unix_micros("window.start").alias("start_us"), "n")


@query(
    f"""WITH {T.ARTICLES_SQL} SELECT article_id, event_s >= {NOW_DOCS} - 86400 AS fresh FROM art"""
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")
    return T.articles(spark, sf_dir).select("article_id", A.fresh(published, F.timestamp_seconds(F.lit(NOW_DOCS))).alias("fresh"))
