"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import conversations, decontam, licenses, negatives
from tessera.llm.html import extract_text
from tessera.llm.langid import identify_languages
from tessera.llm.media import text_tiles
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.records import records_round_trip
from tessera.llm.sharding import shard_documents
from tessera.llm.simhash import simhash_components
from tessera.llm.token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), limit=2048, end_id=1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), budget=1024)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_round_trip(_table(spark, sf_dir, "documents"), end_id=2)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=85, m=10)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op10_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tiles(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(_table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), width=3, most=3)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine_negatives(_table(spark, sf_dir, "embeddings"), positives=5, negatives=3, least=50, most=95, shift=(7, 10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_token_counts, op3_decontamination, op4_token_records, op5_sharding, op6_html_extraction,
        op7_license_scan, op8_near_duplicates, op9_language_id, op10_media_tiles, op11_conversation_repair, op12_simhash, op13_hard_negatives,
    )
}

#: The others need a tokenizer, minhashes, random draws, HTML, XXH64 or a trained model.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontam.ORACLE_SQL,
    "op7_license_scan": licenses.ORACLE_SQL,
    "op11_conversation_repair": conversations.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
