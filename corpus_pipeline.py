"""The training-data pipeline: stages over documents, each one operator of ``airgauge.llm``.

Language ID drops what is in no known language, the n-gram join keeps one document of
each component of near duplicates, decontamination drops documents that hold a benchmark
phrase, and packing cuts the rest into training sequences. Each stage is written as
Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airgauge.llm import decontaminate, language, ngram_join, packing, queries
from airgauge.session import fresh_folder, ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from their labelled rows."""
    ship_package(spark)
    return language.keep_known(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: five-word shingles, Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return ngram_join.keep_one(docs, shingle=5, similarity=(80, 100))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any phrase of the table ``benchmark``."""
    ship_package(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row for each piece of a document, with its token ids."""
    ship_package(spark)
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]
ORACLE_SQL = None  # neither the trained classifier nor the tokenizer is SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        folder = fresh_folder(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
