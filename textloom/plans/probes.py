"""Downloads of pictures through their gates. No given table holds downloads: each article gets three, with measures told from
its id, so that every gate decides somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import desk_lexicons as D
from ..operators import images as I
from . import news as N
from . import tables as T
from .registry import query

CANDIDATES = ("https://img.example.org/{n}.jpg", "https://img.example.org/a/Logo-{n}.jpg", "https://img.example.org/b{n}.png", "https://img.example.org/logos{n}.png", "https://img.example.org/c/{n}/author.webp", "https://img.example.org/d{n}", "https://img.example.org/e{n}")
TYPES = ("image/jpeg", "IMAGE/PNG", "", "text/html", "image/webp")


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N._images(spark, sf_dir).withColumn("fit", I.relevance(I.topic_terms(F.col("title"), F.col("body")), F.col("picture"), F.col("around"), D.UNWANTED))
    rows = rows.select("article_id", "fit", "place", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    i, k = F.col("article_id"), F.col("pos")
    named = lambda values, by: F.replace(N._pick(values, by), F.lit("{n}"), i.cast("string"))
    return rows.select(
        i.alias("candidate_id"), "pos", named(CANDIDATES, i).alias("url"), named(N.PICTURES, F.floor(i / 2) + k * 3).alias("asked"), F.when((i + k) % 7 == 0, named(N.PICTURES, i + 3)).alias("final"),
        F.when((i + k) % 13 == 0, F.lit(None)).when((i * 3 + k) % 11 == 0, 404).otherwise(200).alias("status"), F.when((i + k) % 17 > 0, N._pick(TYPES, i + k * 2)).alias("content_type"),
        F.when((i + k) % 23 > 0, 4000 + (i * 37 + k * 9001) % 60000).alias("bytes"), F.when((i + k) % 9 > 0, 380 + (i * 53 + k * 700) % 2400).alias("width"), (200 + (i * 31 + k * 300) % 1400).alias("height"),
        ((i % 5) * 400).alias("width_hint"), ((i * 7 + k * 11) % 130).cast("double").alias("sharpness"), "fit", "place",
    )


def _named(values: tuple[str, ...], by: str) -> str:
    return f"replace({N._pick_sql(values, by)}, '{{n}}', CAST(i AS VARCHAR))"


def _blocked(x: str) -> str:
    asked = rf"regexp_extract(lower({x}), '^[^?#]*\?([^#]*)', 1)"
    return rf"""(contains(regexp_extract(lower({x}), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '{D.BLOCKED_HOSTS[0]}') OR ends_with(lower({x}), '.svg') OR {T.any_part(f'lower({x})', D.BLOCKED_PARTS)} OR regexp_matches(lower({x}), '{D.BLOCKED_SIZE}')
 OR regexp_matches({asked}, '(?:^|&)[^=&]*(?:{'|'.join(D.BLOCKED_KEYS)})') OR regexp_matches({asked}, '=[^&]*(?:{'|'.join(D.BLOCKED_VALUES)})')
 OR len(list_filter(regexp_extract_all({asked}, '(?:^|&)(?:w|width|h|height|resize)=[^&0-9]*([0-9]+)', 1), lambda n: CAST(n AS DOUBLE) < 220)) > 0)"""


_SQL = rf"""WITH {N._IMAGES}, d0 AS (SELECT article_id AS i, fit, place, unnest([0, 1, 2]) AS k FROM i3),
d1 AS (SELECT i, k, fit, place, {_named(CANDIDATES, 'i')} AS url, {_named(N.PICTURES, '(i // 2) + k * 3')} AS asked, CASE WHEN (i + k) % 7 = 0 THEN {_named(N.PICTURES, 'i + 3')} END AS other,
 CASE WHEN (i + k) % 13 = 0 THEN NULL WHEN (i * 3 + k) % 11 = 0 THEN 404 ELSE 200 END AS status, lower(coalesce(CASE WHEN (i + k) % 17 > 0 THEN {N._pick_sql(TYPES, 'i + k * 2')} END, '')) AS type,
 coalesce(CASE WHEN (i + k) % 23 > 0 THEN 4000 + (i * 37 + k * 9001) % 60000 END, 0) AS size, CASE WHEN (i + k) % 9 > 0 THEN 380 + (i * 53 + k * 700) % 2400 END AS w, 200 + (i * 31 + k * 300) % 1400 AS h, (i % 5) * 400 AS hint,
 CAST((i * 7 + k * 11) % 130 AS DOUBLE) AS sharp FROM d0),
d2 AS (SELECT * EXCLUDE (w, h), coalesce(other, asked) AS final, CASE WHEN w IS NOT NULL THEN w WHEN starts_with(type, 'image/') AND hint >= 400 AND size >= 15000 THEN hint END AS width,
 CASE WHEN w IS NOT NULL THEN h ELSE greatest(220, CAST(floor(hint / 1.77) AS BIGINT)) END AS height FROM d1),
d3 AS (SELECT *, CASE WHEN regexp_matches(lower(url), '{I.NOT_PICTURES}') THEN 'url_pattern_rejected' WHEN {_blocked('asked')} THEN 'overlay_or_branding_url_rejected' WHEN status IS NULL OR status <> 200 THEN 'download_failed'
 WHEN {_blocked('final')} THEN 'overlay_or_branding_url_rejected' WHEN type <> '' AND NOT contains(type, 'image') THEN 'non_image_content' WHEN width IS NULL THEN 'unknown_dimensions' WHEN width < 400 OR height < 220 THEN 'resolution_too_low'
 WHEN size < 15000 AND width * height < 900000 THEN 'file_too_small' WHEN width / height < 0.35 OR width / height > 3.2 THEN 'extreme_aspect_ratio' WHEN sharp < 6 THEN 'blur_detected'
 WHEN fit < 0.1 AND place IN ('body', 'srcset', 'schema') THEN 'low_relevance' END AS reason,
 round(CAST(least(1.5, width * height / (1920.0 * 1080.0)) * 0.48 + least(1.0, sharp / 100.0) * 0.22 + fit * 0.24 + {N._BONUS_SQL} AS DOUBLE), 6) AS score FROM d2),
b AS (SELECT i, arg_max(k, (score, -k)) FILTER (reason IS NULL) AS pos, arg_min(reason, (list_position([{T.quoted(('url_pattern_rejected', *D.REASONS))}], reason), k)) FILTER (reason IS NOT NULL) AS why FROM d3 GROUP BY 1)
SELECT b.i AS candidate_id, b.pos IS NOT NULL AS ok, b.pos, d3.score, CAST(d3.width AS INT) AS width, CAST(d3.height AS INT) AS height, CASE WHEN b.pos IS NULL THEN why END AS reason FROM b LEFT JOIN d3 ON b.i = d3.i AND b.pos = d3.k"""


@query(_SQL)
def picture_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best download of each candidate picture, or the most telling reason against it."""
    return I.probed(downloads(spark, sf_dir)).withColumn("score", F.round("score", 6))
