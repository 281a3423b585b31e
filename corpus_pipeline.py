"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, line_dedup, minhash, packing, quality
from textloom.llm.queries import tokenizer_path
from textloom.llm.shared import new_folder, remove
from textloom.sources.stored import passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go from the texts; ``n_chars`` follows."""
    out = line_dedup.remove_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL has no zstandard, SimHash or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on all documents. A stage's table goes once the next one is stored, and with it what the stage itself has
    left behind, so at most two stages are on disk; packing stores its result, which is all that stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    *first, (_, last) = STAGES
    try:
        for name, stage in first:
            folder = new_folder(spark, f"stage-{name}")
            with passing(spark):
                stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(folder)
            remove(spark, *before)
            docs, before = spark.read.parquet(folder), [folder]
        return last(spark, docs, sf_dir)
    finally:
        remove(spark, *before)
