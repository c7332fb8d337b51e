"""A corpus pipeline of four stages: language identification, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import shared_dir
from tessera.llm.decontam import drop_contaminated
from tessera.llm.langid import keep_identified
from tessera.llm.minhash import drop_near_duplicates
from tessera.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay: texts without letters, or with no language at even odds, go."""
    return keep_identified(docs, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80, m=12)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row, or a whole shorter item, with ``benchmark`` go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 2048 tokens."""
    return pack_documents(docs, limit=2048, end_id=1)


STAGES = [("language_id", language), ("minhash_near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the trained language model, minhash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_dir(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
