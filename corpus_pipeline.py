"""Corpus preparation over ``documents``: quality, language, near-duplicates, secrets, packing.

Each stage takes what its predecessor kept. The first four return the columns of ``documents``, the
last one the packed pieces. Between stages the rows are written as Parquet to the shared folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm import langid, minhash, packing, quality, secrets
from skein.llm.common import dropped, table, temporary, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels``, without held-out rows."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.recognised(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the fitted stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage writes for itself, and what it was given, goes once its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
