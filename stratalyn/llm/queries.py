"""One query for each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalyn.llm import bpe, jpeg, langid, mixing, pii, quality_knn, quality_rules, shards, simhash, warc
from stratalyn.llm.common import read_table


#: Where the vocabulary of public tokenizers lies; read on the driver and broadcast.
VOCABULARY = os.environ.get("STRATALYN_VOCABULARY") or (importlib.import_module("public_tokenizers").path("word_bpe_49k.json") if importlib.util.find_spec("public_tokenizers") else "word_bpe_49k.json")


def op1_pii_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digest(read_table(spark, sf_dir, "documents"))


def op3_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read_table(spark, sf_dir, "documents"))


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).drop("text")


def op6_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.round_trip(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op8_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read_table(spark, sf_dir, "documents"))


def op10_simhash_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_boosted_spans, op2_progressive_jpeg, op3_fair_queue_mix, op4_prefix_bpe, op5_decision_list,
        op6_neighbour_votes, op7_feistel_shards, op8_warc_members, op9_ppm_language, op10_simhash_vantage_points,
    )
}
#: The others cannot be expressed in SQL (trained models, binary formats, XXH64 bits); tests hold them against brute force.
ORACLES = {"op3_fair_queue_mix": mixing.ORACLE, "op8_warc_members": warc.ORACLE}
