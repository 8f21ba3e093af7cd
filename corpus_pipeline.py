"""A training corpus from the table ``documents``: five stages of the operators in ``paneltide.llm``.

Every stage works on all rows its predecessor kept and, but for the last, returns the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneltide.llm.common import arrow_session, fresh_path
from paneltide.llm.exact_dedup import drop_copies
from paneltide.llm.jaccard_join import drop_near_copies
from paneltide.llm.mixing import mix_documents
from paneltide.llm.packing import pack_documents
from paneltide.llm.quality_classifier import keep_good
from paneltide.llm.queries import MIX_TARGETS

#: Part of the tokens that reaches the mix's last stage.
MIX_SHARE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the co-trained classifier rejects go."""
    labels = arrow_session(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return keep_good(docs, labels)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked weights of source, language and topic."""
    return mix_documents(docs, MIX_TARGETS, MIX_SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in context windows."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near duplicates", near), ("mix", mix), ("pack", pack)]

#: The first and last stages need a learned model and a tokenizer, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written to the shared folder and read again."""
    docs = arrow_session(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = fresh_path(spark, f"stage-{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
