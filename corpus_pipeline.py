"""A corpus from raw documents to packed sequences, in stages that are each written and read again.

run() applies the stages to `documents`. No SQL: a classifier and a tokenizer can't be expressed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from areascope.llm import language_id, line_dedup, mixing, ngram_join, packing
from areascope.llm.queries import tokenizer_path
from areascope.session import checkpoint_dir


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus is labelled with; others are rejected."""
    return language_id.known_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them."""
    return line_dedup.dedup_lines(docs, 40, 5)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares three quarters of its 5-word shingles."""
    return ngram_join.one_of_each(docs, 75)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weight; a document taken twice is in the result twice."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("mixing", mixture),
    ("packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
