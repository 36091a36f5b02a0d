"""Raw documents to packed training sequences, in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusweave.llm import stages
from locusweave.llm.common import staged, table

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("pii", stages.pii),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: Language models, sketches and surrogates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, "stage")
    return docs
