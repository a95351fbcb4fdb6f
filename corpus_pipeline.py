"""Corpus pipeline: language ID, near-duplicates, decontamination, PII, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything its predecessor kept;
``run`` writes each result as Parquet into the shared checkpoint folder and reads it back
as the next stage's ``docs``. All but the last return the columns of ``docs``.

Null or empty texts have no letters and are rejected by the first stage; an empty table
passes through every stage; extra columns are carried along until packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import packing, pii, ppm, sigtree, winnow
from tidepanel.llm.text import prepare_session
from tidepanel.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the language of the text; documents in no learned language go."""
    prepare_session(spark)
    return ppm.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8) stays."""
    prepare_session(spark)
    return sigtree.keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    prepare_session(spark)
    return winnow.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the new text."""
    prepare_session(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of at most 1024 ids."""
    prepare_session(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", redact_personal_data),
    ("packing", pack),
]

ORACLE_SQL: str | None = None  # model-based stages: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{i}")
    return docs
