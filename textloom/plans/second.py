"""Queries over copy in a second language. The driver's texts hold none, so each article's copy is made of phrases picked by its
id, with its own title or, for every fourth, its whole body at the end: short, long, broken-off and empty copies occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import second_language as L
from . import tables as T
from .registry import query

PHRASES = (
    "పోలీసులు  సోమవారం వంతెనను మూసివేశారు .", "అధికారులు Impact పై “స్పందించారు”,", "ప్రభుత్వం dialogue dialogue కోరింది!", "వర్షాలు కొనసాగుతున్నాయి,", "నగరంలో tension పెరిగింది।",
    "రైతులు ఆందోళన చేశారు మరియు మార్కెట్లు మూతపడ్డాయి", "", "UN మరియు NATO చర్చలు జరిపాయి :", "India escalation’ పై స్పందన ?",
)
#: How many phrases a copy has, and by which steps they are picked.
STEPS = (1, 3, 5, 7, 11, 13, 17, 19, 23)


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("article_id")
    pick = lambda by: F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(by, F.lit(len(PHRASES))) + 1).cast("int"))
    parts = F.slice(F.array(*(pick(F.floor(i / s) + k) for k, s in enumerate(STEPS))), 1, (i % 10).cast("int"))
    tail = F.when(i % 4 == 0, F.col("body")).when(i % 4 == 1, F.col("title")).otherwise("")
    return T.articles(spark, sf_dir).select("article_id", "title", "body", F.concat(F.array_join(parts, " "), F.lit(" "), F.coalesce(tail, F.lit(""))).alias("copy"))


_PARTS = ", ".join(T._pick_sql(PHRASES, f"(article_id // {s}) + {k}") for k, s in enumerate(STEPS))
_COPIES = f"""{T.ARTICLES_SQL}, cp AS (SELECT article_id, title, body, array_to_string(list_slice([{_PARTS}], 1, article_id % 10), ' ') || ' ' ||
 coalesce(CASE article_id % 4 WHEN 0 THEN body WHEN 1 THEN title ELSE '' END, '') AS copy FROM art)"""


def _sanitised(x: str) -> str:
    x = f"trim(regexp_replace({x}, '{L.SPACE}+', ' ', 'g'))"
    x = f"translate({x}, '’“”', '''\"\"')"
    x = rf"regexp_replace({x}, ' +([,.;:!?\x{{964}}])', '\1', 'g')"
    for word, own in L.REPLACED.items():
        # twice, as neighbours share the mark between them
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])(?i:{word})([^\p{{L}}\p{{N}}_]|$)', '\1{own}\2', 'g')"
    return x


_UPTO = lambda x: f"regexp_extract({x}, '(?s)^(.*[{L.STOPS}])', 1)"
_SPACE = lambda x, marks: f"rtrim(CASE WHEN length(regexp_extract({x}, '(?s)^(.+) [^ ]*$', 1)) > 0 THEN regexp_extract({x}, '(?s)^(.+) [^ ]*$', 1) ELSE {x} END, '{marks}')"
_ENDS = lambda x: f"regexp_matches({x}, '[{L.STOPS}]$')"


def _padded(x: str) -> str:
    n, upto, out = f"(CASE WHEN {x} = '' THEN -1 ELSE length({x}) END)", "", "CASE"
    for k in range(L.MOST_TAILS):
        after = L.TAILS[k % len(L.TAILS)]
        out += f" WHEN {n} + {len(upto)} >= {L.BAND[0]} OR {n} + {len(upto) + len(after)} > {L.BAND[1]} THEN ltrim({x} || '{upto}')"
        upto += after
    return f"{out} ELSE ltrim({x} || '{upto}') END"


def _closed(source: str, x: str, name: str) -> str:
    """Two steps: the clean text, then its end."""
    closures = " ".join(f"WHEN length(x) + {len(c)} <= {L.BAND[1]} THEN x || '{c}'" for c in L.CLOSURES)
    short = _SPACE("x", " ,:-")
    return f"""{name}0 AS (SELECT article_id, rtrim({_sanitised(x)}, ' ,:-') AS x FROM {source}),
{name}1 AS (SELECT *, {short} AS s FROM {name}0),
{name} AS (SELECT article_id, CASE WHEN x = '' OR {_ENDS('x')} THEN x WHEN length({_UPTO('x')}) - 1 >= {L.BAND[0] - L.END_SLACK} THEN {_UPTO('x')} {closures} WHEN s = '' OR {_ENDS('s')} THEN s ELSE s || '.' END AS x FROM {name}1)"""


_FITTED = f"""{_COPIES}, sn AS (SELECT article_id, {_sanitised('copy')} AS x FROM cp),
st AS (SELECT article_id, CASE WHEN length(x) <= {L.BAND[1]} THEN {_padded('x')} WHEN length({_UPTO(f'left(x, {L.BAND[1]})')}) - 1 >= {L.BAND[0] - L.CUT_SLACK} THEN {_UPTO(f'left(x, {L.BAND[1]})')}
 ELSE {_SPACE(f'left(x, {L.BAND[1]})', ' ,.-')} END AS x FROM sn),
{_closed('st', 'x', 'ca')}, pd AS (SELECT article_id, {_padded('x')} AS x FROM ca), {_closed('pd', 'x', 'ft')}"""
_SOLID = f"regexp_replace(x, '{L.SPACE}', '', 'g')"
_TITLE = rf"trim(regexp_replace(regexp_replace(regexp_replace({_sanitised('title')}, '\s*,\s*', ': ', 'g'), '\s*:\s*:\s*', ': ', 'g'), '\s+', ' ', 'g'), ' ,.-:')"


@query(f"""WITH {_FITTED} SELECT article_id, ft.x AS fitted, tt AS title, round(CASE WHEN {_SOLID} = '' THEN 0.0 ELSE 100.0 * length(regexp_replace({_SOLID}, '[^\\x{{C00}}-\\x{{C7F}}]', '', 'g')) / length({_SOLID}) END, 6) AS percent
FROM ft JOIN (SELECT article_id, {_TITLE.replace('title', "coalesce(title, '')")} AS tt FROM cp) USING (article_id)""")
def second_language_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy within its band, the title's marks, and the share of the second language's letters."""
    rows = copies(spark, sf_dir).select("article_id", L.fitted("copy").alias("fitted"), L.title("title").alias("title"))
    return rows.select("*", F.round(L.purity("fitted"), 6).alias("percent"))


@query(rf"""WITH {_FITTED}, src AS (SELECT article_id, list_transform(list_filter(regexp_extract_all(coalesce(title, '') || ' ' || coalesce(body, ''), '[A-Za-z][A-Za-z''.-]+'), lambda t: regexp_matches(t, '^[A-Z]')), lambda t: lower(trim(t, '''.-'))) AS ns FROM cp),
kp AS (SELECT article_id, list_concat([{T.quoted(L.KEPT)}], list_filter(ns, lambda t: length(t) >= 2 AND t NOT IN ({T.quoted(L.NOT_NAMES)}))) AS ks FROM src),
lo AS (SELECT article_id, x, list_filter(list_transform(regexp_extract_all(x, '[a-zA-Z]{{2,}}'), lambda t: lower(t)), lambda t: NOT list_contains(ks, t)) AS s FROM ft JOIN kp USING (article_id))
SELECT article_id, CAST(len(s) AS INT) AS words, round(len(s) / greatest(len(regexp_extract_all(x, '{L.SPACE.replace('[', '[^', 1)}+')), 1), 6) AS share, len(list_filter(s, lambda t: length(t) >= 3)) > 0 AS found FROM lo""")
def second_language_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the first language in each fitted copy that neither the list nor the source's names allow."""
    rows = copies(spark, sf_dir).select("article_id", L.fitted("copy").alias("fitted"), L.kept_words("title", "body").alias("kept"))
    return rows.select("article_id", L.left_over("fitted", F.col("kept")).alias("r")).select("article_id", "r.words", F.round("r.share", 6).alias("share"), "r.found")
