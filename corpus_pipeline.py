"""A training corpus from ``documents``: stages that each keep, drop, repeat or place whole rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs; all but the last return the columns
of ``documents``, extra ones included, whatever their names. Rows with null ids and
repeated rows are rows like others until a stage says otherwise; an empty table stays
empty in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import exact_dedup, language_id, mixing, ngram_join, packing
from webstrata.llm.common import shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: null and empty texts, too. Repeated rows stay together."""
    return language_id.accepted_documents(docs, language_id.fit(docs))


def distinct_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row of the smallest doc_id stays, by a new digest index; of repeated rows one."""
    return exact_dedup.dedup_documents(docs, exact_dedup.DigestIndex(spark))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the smallest doc_id stays, with its repeated rows (exact dedup comes before); rows without an id and texts without words are linked with nothing and stay."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those of no words are taken by none, a null source is a source."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is the end mark alone."""
    return packing.pack(docs)


STAGES = [("language_id", known_language), ("exact_dedup", distinct_text), ("ngram_join", one_of_near_copies), ("mixing", mixed), ("packing", packed)]
#: Language identification learns a model, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
