"""A corpus from raw documents: five stages, each one of the library's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the
stage before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import WS, materialize
from tessera.llm.decontamination import decontaminate
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mix
from tessera.llm.near_dedup import drop_near_duplicates
from tessera.llm.quality import score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.3 or more)."""
    scored = score_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)
    return scored.filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more stay in the first only; documents that lose all their lines go."""
    kept = dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1, keep="first")
    kept = kept.filter((F.col("n_dropped") == 0) | (F.trim("text", F.lit(WS + "\n")) != ""))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, width=5, threshold=0.8).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item: less than 0.8 of the shingles of five words of each."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=5, threshold=0.8).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken and where it stands in training, sorted by that position."""
    return mix(docs, weights=(5, 2, 1), max_repeats=3).select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "position", "positions")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("mixing", mixture)]

#: The trained classifier can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
