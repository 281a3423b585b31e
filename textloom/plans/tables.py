"""How the driver's tables are read as articles, events and runs: the same derivation in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Seconds between articles, by doc_id, from 2024-01-01.
STEP, START = 420, 1704067200
SOURCES = ("TOI", "BBC", "NDTV", "Reuters", "AlJazeera", "India Today", "The Hindu", "Guardian")
CATEGORIES = ("international", "national", "politics", "business", "tech", "sports")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, title (the text's first sentence, cut), body, url, source, source_url, category, event_ts."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("article_id"), F.trim(F.left(F.substring_index("text", ".", 1), F.lit(90))).alias("title"), F.col("text").alias("body"),
        F.concat(F.lit("https://www.Example.org/News/"), doc, F.lit("/?utm=1")).alias("url"), pick(SOURCES, doc).alias("source"),
        F.concat(F.lit("https://example.org/"), pick(("world", "india", "politics", "business", "tech", "sport"), doc)).alias("source_url"),
        pick(CATEGORIES, F.floor(doc / 3)).alias("category"), F.timestamp_seconds(doc * STEP + START).alias("event_ts"),
    )


def _pick_sql(values: tuple[str, ...], by: str) -> str:
    return f"list_extract([{', '.join(f"'{v}'" for v in values)}], CAST(({by}) % {len(values)} AS INT) + 1)"


ARTICLES_SQL = f"""art AS (
  SELECT doc_id AS article_id, trim(left(split_part(text, '.', 1), 90)) AS title, text AS body,
         'https://www.Example.org/News/' || doc_id || '/?utm=1' AS url, {_pick_sql(SOURCES, "doc_id")} AS source,
         'https://example.org/' || {_pick_sql(("world", "india", "politics", "business", "tech", "sport"), "doc_id")} AS source_url,
         {_pick_sql(CATEGORIES, "doc_id // 3")} AS category, doc_id * {STEP} + {START} AS event_s
  FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (with zone), run_id (a user's run), event_type, value, props."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"), "event_type", "value", "props")


# SQL of the text functions, for DuckDB.


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normalise(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _synonym(w: str) -> str:
    from ..functions.lexicons import SYNONYMS

    return f"CASE {w} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items()) + f" ELSE {w} END"


_CUT = """CASE WHEN c LIKE '%ies' AND length(c) > 5 THEN left(c, length(c) - 3) || 'y' WHEN c LIKE '%ing' AND length(c) > 6 THEN left(c, length(c) - 3)
 WHEN c LIKE '%ed' AND length(c) > 5 THEN left(c, length(c) - 2) WHEN c LIKE '%es' AND length(c) > 5 THEN left(c, length(c) - 2)
 WHEN c LIKE '%s' AND length(c) > 4 THEN left(c, length(c) - 1) ELSE c END"""


def canonical(tokens: str) -> str:
    from ..functions.lexicons import GENERIC, STOPWORDS

    steps = f"list_transform(list_transform(list_transform({tokens}, lambda a: {_synonym('a')}), lambda c: {_CUT}), lambda e: {_synonym('e')})"
    return f"list_filter({steps}, lambda t: length(t) >= 3 AND t NOT IN ({quoted((*STOPWORDS, *GENERIC))}))"


def salient(x: str) -> str:
    return canonical(words(normalise(x)))


def sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({collapse(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def lead(x: str) -> str:
    return f"left(array_to_string(list_slice({sentences(x)}, 1, 2), ' '), 320)"


def plain(x: str) -> str:
    """Word bounds of SQL's expressions know ASCII alone: other letters become a mark that counts as one."""
    return rf"regexp_replace({x}, '[^\x00-\x7F]', '_', 'g')"


def entities(x: str) -> str:
    found = rf"regexp_extract_all({plain(x)}, '\b[A-Z][A-Za-z0-9''-]{{2,}}\b')"
    return canonical(f"list_transform({found}, lambda r: lower(r))")


def numbers(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({normalise(x)}, '\b\d+\b'))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def keyword_count(x: str, keywords) -> str:
    keywords = list(dict.fromkeys(keywords))
    single, phrases = [k for k in keywords if " " not in k], [k for k in keywords if " " in k]
    parts = [rf"len(list_distinct(regexp_extract_all({x}, '\b({'|'.join(single)})\b', 1)))"] if single else []
    return "(" + " + ".join(parts + [f"CAST(contains({x}, '{p}') AS INT)" for p in phrases]) + ")"


def any_part(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"
