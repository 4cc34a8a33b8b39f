"""The corpus pipeline: five operators in turn, each stage's result written as Parquet and read again as the next one's documents.

Defined cases: null and empty texts have no language and go at the first stage; each row is judged by its own text and stays with all
columns as they are, whatever their names, also where its doc_id is null or that of other rows; of copies the one with the smallest doc_id
stays (nulls last, then any one row); an empty table gives empty results; texts of any length are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, packing, quality_mil, simhash
from .common import stage


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay, that is all but `und`."""
    return language_id.known_languages(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be good stay."""
    return quality_mil.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", languages), ("quality", quality), ("exact_dedup", copies), ("simhash", near_copies), ("packing", packed)]

#: Classifiers and fingerprints aren't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
