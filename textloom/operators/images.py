"""Pictures by their addresses and measures: which are refused, how well they fit, which is taken. Nulls count as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import desk_lexicons as D
from ..functions import text as X


def blocked(url: Column) -> Column:
    """Addresses of logos, overlays, placeholders and small sizes. Escapes in the query aren't decoded."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    asked = F.regexp_extract(low, r"^[^?#]*\?([^#]*)", 1)
    keys, values = "|".join(D.BLOCKED_KEYS), "|".join(D.BLOCKED_VALUES)
    small = lambda names: F.exists(F.regexp_extract_all(asked, F.lit(rf"(?:^|&)(?:{names})=[^&0-9]*([0-9]+)"), F.lit(1)), lambda n: n.cast("double") < 220)
    return (
        X.any_part(host, D.BLOCKED_HOSTS) | low.endswith(".svg") | X.any_part(low, D.BLOCKED_PARTS) | low.rlike(D.BLOCKED_SIZE)
        | asked.rlike(rf"(?:^|&)[^=&]*(?:{keys})") | asked.rlike(rf"=[^&]*(?:{values})") | small("w|width|h|height|resize")
    )


def large_enough(width: Column, height: Column, least: tuple[int, int] = (640, 480)) -> Column:
    """Unknown measures pass."""
    return width.isNull() | height.isNull() | ((width >= least[0]) & (height >= least[1]))


def topic_terms(title: Column, context: Column) -> Column:
    """Up to twelve distinct terms of the title and the article's first 500 characters, which are its topic."""
    blob = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(F.coalesce(context, F.lit("")), F.lit(500))))
    found = F.regexp_extract_all(blob, F.lit("[a-z0-9]{4,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(*D.TOPIC_STOPWORDS))), 1, 12)


def relevance(terms: Column, url: Column, around: Column, unwanted: tuple[str, ...]) -> Column:
    """How many of the terms the address and the text around a picture hold, less for unwanted text; from 0 to 1."""
    address, near = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(around, F.lit("")))
    hits = lambda text: F.size(F.filter(terms, lambda t: F.contains(text, t)))
    n = F.size(terms)
    score = 0.08 + hits(address) / F.greatest(n, F.lit(1)) * 0.55 + hits(near) / F.greatest(F.least(n, F.lit(8)), F.lit(1)) * 0.37
    score = score - F.when(X.any_part(near, unwanted), 0.25).otherwise(0.0)
    return F.when(n == 0, F.lit(0.1)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def score(width: Column, height: Column, sharpness: Column, fit: Column, place: Column) -> Column:
    """Size, sharpness and fit in one figure, with what the picture's place on the page adds."""
    bonus = F.lit(0.02)
    for name, value in D.PLACE_BONUS.items():
        bonus = F.when(place == name, value).otherwise(bonus)
    return F.least(F.lit(1.5), width * height / (1920.0 * 1080.0)) * 0.48 + F.least(F.lit(1.0), sharpness / 100.0) * 0.22 + fit * 0.24 + bonus


def main_reason(reasons: Column) -> Column:
    """The most telling of an array of reasons, the first one if none is listed, 'download_failed' for none."""
    listed = F.get(F.filter(F.array(*map(F.lit, D.REASONS)), lambda r: F.array_contains(reasons, r)), F.lit(0))
    return F.coalesce(listed, F.get(reasons, F.lit(0)), F.lit("download_failed"))


def unused(rows: DataFrame, used: DataFrame, picture: str = "picture") -> DataFrame:
    """Rows whose picture (an address, ends trimmed) no row of ``used`` has. Rows without a picture stay."""
    key = F.trim(F.coalesce(F.col(picture), F.lit("")))
    taken = used.select(key.alias("_taken")).where("_taken <> ''").distinct()
    return rows.join(taken, key == F.col("_taken"), "left_anti")


# Least and most measures of a picture, places whose pictures must fit the topic, and names of no pictures.
LEAST = {"width": 400, "height": 220, "bytes": 15000, "aspect": (0.35, 3.2), "sharpness": 6.0, "fit": 0.10, "megapixels": 0.9}
NOISY_PLACES = ("body", "srcset", "schema")
NOT_PICTURES = r"(?:^|[/_-])(logo|sprite|icon|favicon|avatar|author|profile|reporter|screenshot)(?:$|[._/-])"


def _measures(p: DataFrame, least: dict) -> tuple[Column, Column]:
    """(width, height): those of the bytes, or what the page tells of a large enough picture; null if neither is known."""
    told = p["content_type"].startswith("image/") & (p["width_hint"] >= least["width"]) & (p["bytes"] >= least["bytes"])
    known = p["width"].isNotNull() & p["height"].isNotNull()
    hint = F.greatest(F.lit(least["height"]), F.floor(p["width_hint"] / 1.77).cast("int"))
    return F.when(known, p["width"]).when(told, p["width_hint"]), F.when(known, p["height"]).when(told, hint)


def probed(probes: DataFrame, key: str = "candidate_id", least: dict = LEAST) -> DataFrame:
    """One row a candidate picture: the best of its downloads, or why there is none.

    Expects key, pos (the order of the downloads, from 0), url (the candidate's), asked and final (addresses of the
    download), status, content_type, bytes, width, height, width_hint, sharpness, fit and place. A download's reason is the
    first gate that it fails; nulls: a status or a size in bytes is a failed or an empty download, a type passes, a final
    address is the asked one, sharpness and fit are 0, a place is any other. Gives key, ok, pos, score,
    width and height of the best download (the first of equals), or nulls and ``reason``: the most telling one of its downloads,
    the first if none is listed; a candidate whose address can't be a picture's is refused before any download. Rows of a null key are one
    candidate; equal rows count once. One aggregation, combined before the shuffle: rows a candidate don't matter."""
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    p = probes.select(
        F.col(key).alias(key), F.col("pos").alias("pos"), none("url", "").alias("url"), none("asked", "").alias("asked"), F.coalesce("final", "asked", F.lit("")).alias("final"), F.col("status").alias("status"),
        F.lower(none("content_type", "")).alias("content_type"), none("bytes", 0).alias("bytes"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
        none("width_hint", 0).cast("int").alias("width_hint"), none("sharpness", 0.0).alias("sharpness"), none("fit", 0.0).alias("fit"), none("place", "").alias("place"),
    )
    wide, high = _measures(p, least)
    p = p.withColumns({"width": wide, "height": high})
    aspect = F.col("width") / F.greatest(F.lit(1), F.col("height"))
    reason = (
        F.when(F.lower("url").rlike(NOT_PICTURES), "url_pattern_rejected").when(blocked(F.col("asked")), "overlay_or_branding_url_rejected")
        .when(F.col("status").isNull() | (F.col("status") != 200), "download_failed").when(blocked(F.col("final")), "overlay_or_branding_url_rejected")
        .when((F.col("content_type") != "") & ~F.contains("content_type", F.lit("image")), "non_image_content").when(F.col("width").isNull(), "unknown_dimensions")
        .when((F.col("width") < least["width"]) | (F.col("height") < least["height"]), "resolution_too_low")
        .when((F.col("bytes") < least["bytes"]) & (F.col("width").cast("long") * F.col("height") / 1e6 < least["megapixels"]), "file_too_small")
        .when(~aspect.between(*least["aspect"]), "extreme_aspect_ratio").when(F.col("sharpness") < least["sharpness"], "blur_detected")
        .when((F.col("fit") < least["fit"]) & F.col("place").isin(*NOISY_PLACES), "low_relevance")
    )
    p = p.withColumn("reason", reason).withColumn("score", score(F.col("width").cast("double"), F.col("height").cast("double"), F.col("sharpness"), F.col("fit"), F.col("place")))
    telling = F.array_position(F.array(F.lit("url_pattern_rejected"), *map(F.lit, D.REASONS)), F.col("reason"))
    passed = F.when(F.col("reason").isNull(), F.struct(F.col("score").alias("score"), (-F.col("pos")).alias("before"), "width", "height"))
    failed = F.when(F.col("reason").isNotNull(), F.struct(F.when(telling > 0, telling).otherwise(99).alias("telling"), "pos", "reason"))
    found = p.groupBy(key).agg(F.max(passed).alias("best"), F.min(failed).alias("worst"))
    ok = F.col("best").isNotNull()
    return found.select(key, ok.alias("ok"), (-F.col("best.before")).alias("pos"), F.col("best.score").alias("score"), F.col("best.width").alias("width"), F.col("best.height").alias("height"), F.when(~ok, F.col("worst.reason")).alias("reason"))
