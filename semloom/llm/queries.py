"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semloom.llm import audit, decontaminate, embeddings, infill, language, licenses, neardup, packing, quality, scoring, tokens, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_license_scans": licenses.op2_license_scans,
        "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_embedding_near_dedup": embeddings.op5_embedding_near_dedup,
        "op6_language_id": language.op6_language_id,
        "op7_url_filters": urls.op7_url_filters,
        "op8_minhash_near_dedup": neardup.op8_minhash_near_dedup,
        "op9_packing": packing.op9_packing,
        "op10_warc": warc.op10_warc,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_fill_in_middle": infill.op12_fill_in_middle,
        "op13_lm_scoring": scoring.op13_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op5_embedding_near_dedup": embeddings.ORACLE_SQL,
        "op7_url_filters": urls.ORACLE_SQL,
        "op8_minhash_near_dedup": neardup.ORACLE_SQL,
        "op10_warc": warc.ORACLE_SQL,
        "op11_filter_audit": audit.ORACLE_SQL,
        "op12_fill_in_middle": infill.ORACLE_SQL,
        "op13_lm_scoring": scoring.ORACLE_SQL,
    }
