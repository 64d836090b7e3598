"""The corpus pipeline: stages from raw documents to packed sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import pii
from graphloom.llm.common import written
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.langid import UNKNOWN, identify, language_profiles
from graphloom.llm.neardup import deduplicate
from graphloom.llm.packing import pack

#: Rows in an Arrow batch: texts are long, and a batch is held by Spark and by its Python worker at the same time.
BATCH_ROWS = 2_000
#: Words that a packing worker remembers: fewer than by default, as the executor's heap is full by then.
REMEMBERED = 50_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rank orders, similarity components, learned spans and dynamic programming are beyond SQL.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no identifiable language: null texts and texts without a letter.

    The profiles are learned from all documents that name their language; if none does, nothing can be identified and
    no document is rejected for it.
    """
    profiles = written(language_profiles(docs), "profiles")
    if not profiles.limit(1).count():
        return docs.select(*COLUMNS)
    named = identify(docs, profiles, keep=COLUMNS)
    return named.where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return deduplicate(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the new text."""
    found = pii.find_pii(docs, pii.fit(docs), keep=("doc_id", "lang", "source"), redact=True)
    text = F.col("redacted")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with small Arrow batches set for the session."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", _bounded(language_stage)),
    ("near-duplicates", _bounded(dedup_stage)),
    ("decontamination", _bounded(decontamination_stage)),
    ("personal data", _bounded(pii_stage)),
    ("packing", _bounded(packing_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
