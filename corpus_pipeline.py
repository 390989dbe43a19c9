"""A corpus pipeline: language, line dedup, near-duplicate documents, mixing, and token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from driftgrid.llm import backoff_langid, block_mix, line_runs, minmax_hash  # noqa: E402
from driftgrid.llm.common import ready  # noqa: E402
from driftgrid.llm.queries import bpe_digest  # noqa: E402
from driftgrid.session import store  # noqa: E402


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters, or with no language ahead of the others together, go."""
    ready(spark)
    return backoff_langid.accept(docs, backoff_langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds."""
    return with_length(line_runs.dedup_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return minmax_hash.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, one row per document and pass over its source."""
    return with_length(block_mix.mixed_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe_digest(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixing", mixing), ("tokens", tokens)]

#: Language model, permutations of slots and byte-pair merges have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back for the next one."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
