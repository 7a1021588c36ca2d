"""The corpus pipeline: quality rules, near-duplicates, personal data, packing. Each stage is written and read again."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymesh.llm import neardup, packing, pii, quality
from waymesh.llm.queries import WORD_TOKENIZER
from waymesh.llm.shared import saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, WORD_TOKENIZER).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_stage), ("near_duplicates", near_duplicate_stage), ("personal_data", personal_data_stage), ("packing", packing_stage)]

#: Certified cutoffs, components and tokens are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = made if number == len(STAGES) - 1 else saved(made, name)
    return docs
