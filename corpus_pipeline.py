"""The corpus pipeline: documents through five operators, each stage written and read again by its caller.

Quality classifier, near-duplicate removal, redaction of personal data, mixing to target weights, encoding. Every stage
but the last returns the columns of documents; the mix repeats and cuts rows, so a doc_id may occur up to three times
after it. The last stage returns the digest columns of the encoder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalyn.llm import bpe, mixing, pii, quality_knn, simhash
from stratalyn.llm.common import delete, new_folder, read_table
from stratalyn.llm.queries import VOCABULARY


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_knn.accepted(docs, read_table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; n_chars follows."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them, as digests."""
    return bpe.digest(docs, VOCABULARY)


STAGES = [("quality classifier", classify), ("near duplicates", deduplicate), ("personal data", redact), ("mixing", mix), ("encoding", encode)]

#: The stages hold trained models and XXH64 fingerprints, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages a Parquet table in the shared folder cuts the lineage.

    A stage's table is deleted once the next one is written; the last one stays, as the result reads it.
    """
    docs, folder = read_table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
