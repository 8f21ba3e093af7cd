"""The operators over the sample tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paneltide.llm import (
    decision_lists, exact_dedup, filter_audit, html_text, jaccard_join, licenses, mixing, packing, pii, quality_classifier, sharding,
    vector_codes, wavelet,
)
from paneltide.llm.common import arrow_session

#: Relative token weights of the mix; what is not listed counts as ``*``.
MIX_TARGETS = {
    "source": {"src0": 4.0} | {f"src{i}": 1.0 for i in range(1, 20)},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12},
    "topic": {"symbols": 0.03, "table": 0.05, "figures": 0.02, "note": 0.1, "article": 0.5, "book": 0.3},
}
MIX_SHARE = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return arrow_session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_weights(_table(spark, sf_dir, "documents"), MIX_TARGETS, MIX_SHARE)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(_table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_lists.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(spark, f"{sf_dir.rstrip('/')}/documents.parquet", _table(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_mix_sources, op3_personal_data, op4_pack, op5_shards, op6_html_text, op7_exact_dedup,
        op8_wavelet, op9_quality, op10_decision_list, op11_filter_audit, op12_license_scan, op13_vector_codes,
    )
}

#: The other operators need a tokenizer, a checksum or a learned model, which SQL lacks, or
#: (op1) take SQL too long on whole tables; they are tested against brute force.
ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_vector_codes": vector_codes.oracle(),
}
