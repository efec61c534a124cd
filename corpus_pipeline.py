"""The text pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, decontaminate, language_id, quality_rules, simhash
from tallyloom.session import work_folder

#: A language's share of all corrected popcounts; a text that fits no language well stays below.
LEAST_SCORE = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return quality_rules.keep(docs, _table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return language_id.keep(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the contamination rule."""
    return decontaminate.keep(docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of tokens, the digest of the ids and the digest of the decoded text."""
    return bpe.with_digests(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("text")


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", contamination),
    ("BPE", encoded),
]

#: Learned cutoffs, Bloom filters, XXH64 and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if at + 1 == len(STAGES):
            return result
        folder = work_folder(spark, f"stage-{at}")
        result.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
