"""JSON as people and models write it: lines of which some are broken, and objects in fences or in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let


def _whole(text: Column) -> Column:
    """The text if it is one JSON value and nothing else, else null.

    The parser stops after a value, whatever follows; what is a value in an array and in an object is one as a whole."""
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(inside & (text != ""), text)


def found_object(raw: Column) -> Column:
    """The JSON in a text: all of it, without a fence of back quotes, or from its first brace to its last; null if none."""
    text = F.btrim(F.coalesce(raw, F.lit("")), F.lit(" \t\n\r\f\x0b"))
    bare = F.regexp_replace(F.btrim(text, F.lit("`")), r"(?s)\A(.*?)json", "$1")
    text = F.when(text.startswith("```"), F.btrim(bare, F.lit(" \t\n\r\f\x0b"))).otherwise(text)
    return let(text, lambda t: F.coalesce(_whole(t), _whole(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")))))


def typed(raw: Column, schema: str) -> Column:
    """The object in a text as a struct; null if there is none. Fields of another type, or missing, are null."""
    return F.from_json(found_object(raw), schema)


def read_lines(spark: SparkSession, path: str, schema: str, needed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of a file of JSON lines, and the lines that aren't rows (`line`, `reason`): 'not_json' or 'incomplete' (a needed
    field is missing or blank). Empty lines are neither. String fields come with single spaces, and missing ones are empty."""
    lines = spark.read.text(path).select(F.btrim("value", F.lit(" \t\r\n")).alias("line")).where("line <> ''")
    lines = lines.withColumn("_json", _whole(F.col("line")).isNotNull() & F.col("line").startswith("{")).withColumn("row", F.from_json("line", schema))
    fields = lines.select("row.*").schema.fields
    clean = F.struct(*(F.btrim(F.regexp_replace(F.coalesce(F.col(f"row.{f.name}"), F.lit("")), r"(?U)\s+", " ")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"row.{f.name}") for f in fields))
    lines = lines.withColumn("row", clean)
    whole = F.lit(True)
    for name in needed:
        whole = whole & F.coalesce(F.col(f"row.{name}").cast("string") != "", F.lit(False))
    reason = F.when(~F.col("_json"), "not_json").when(~whole, "incomplete")
    lines = lines.withColumn("reason", reason)
    return lines.where("reason IS NULL").select("row.*"), lines.where("reason IS NOT NULL").select("line", "reason")
