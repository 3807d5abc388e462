"""A training-data pipeline over ``documents``: judge, dedupe, mask, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
below the shared folder and reads it back as the next stage's documents.  All stages but the
last return the columns of ``documents``.  NULLs, empty texts, repeated rows and empty
tables are handled as each operator's docstring says; ``tests/llm`` checks the chain against
a plain version of every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm import classifier, forest, mixing, pii, queries, tokens
from stepwell.llm.textkit import prepare, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weak-label classifier rejects."""
    prepare(spark)
    return classifier.judge(docs).filter("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group on five-word shingles at a likeness of 0.8."""
    prepare(spark)
    return forest.keep_one(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; ``n_chars`` follows the new text."""
    prepare(spark)
    clean = pii.pseudonymise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as the mix takes it."""
    prepare(spark)
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded bytes."""
    prepare(spark)
    return queries.id_digests(tokens.encode_decode(docs, *queries.rank_file()), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("bpe", encoding),
]

# SQL cannot express expectation maximisation, the trained scorer and byte-pair merges
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
