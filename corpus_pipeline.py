"""Raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import dedup, langid, packing, quality, secrets
from corpusloom.llm.common import vocabulary
from corpusloom.session import ship
from corpusloom.storage import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the trees are learned from the labels of the stage's own input."""
    ship(spark)
    return langid.known_languages(docs, langid.fit(docs))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the quality fences of their language and source."""
    ship(spark)
    return quality.clean(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its shingles of five words."""
    ship(spark)
    return dedup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    ship(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 1024."""
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("near_copies", remove_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # prediction by partial matching has no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
