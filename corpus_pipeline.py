"""Training-data pipeline: quality rules, near-duplicates, decontamination, PII, packing.

Each stage takes all rows that its predecessor kept.  Between stages the documents are written as
Parquet into the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotcast.llm.common import query, table
from slotcast.llm.contamination import remove_contamination
from slotcast.llm.near_duplicates import keep_one_each
from slotcast.llm.packing import pack
from slotcast.llm.repetition import keep_good
from slotcast.llm.surrogates import replace_entities
from slotcast.session import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out of contaminated documents."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    return replace_entities(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin, place and capacity of every piece of every document."""
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("pii surrogates", private_data),
    ("best-fit packing", packing),
]
#: Hashes, surrogates and the packing plan can't be written as SQL; see tests/llm.
ORACLE_SQL = None


@query("pipeline")
def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{place}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
