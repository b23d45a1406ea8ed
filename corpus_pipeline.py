"""Corpus pipeline: documents -> clean, deduplicated, decontaminated, mixed
token files.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents; the last
writes the token files and returns one row per document read back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagecurate.llm.common import written
from pagecurate.llm.decontaminate import drop_leaks
from pagecurate.llm.mixing import mix
from pagecurate.llm.near_dup import drop_near_dups
from pagecurate.llm.queries import shipped
from pagecurate.llm.token_files import default_tokenizer, tokens_of
from pagecurate.llm.toxicity import drop_toxic

SOURCE_WEIGHTS = (5, 2, 1)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return drop_near_dups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, as the source mix takes them."""
    return mix(docs, SOURCE_WEIGHTS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files; one row per document read back."""
    return tokens_of(docs, default_tokenizer())


STAGES = [(name, shipped(stage)) for name, stage in (
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
    ("mix", mix_sources), ("token_output", token_output))]

#: The learned classifier and the tokenizer are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
