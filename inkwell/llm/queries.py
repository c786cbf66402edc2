"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_preference, collocations, decontaminate, license_scan, line_dedup, mixing, near_dedup, personal_data, pipeline, quality_rules, sharding, spelling_variants, substring_dedup, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": url_filters.op1_url_filters,
        "op2_shard": sharding.op2_shard,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_chat_preference": chat_preference.op8_chat_preference,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_spelling_variants": spelling_variants.op11_spelling_variants,
        "op12_collocations": collocations.op12_collocations,
        "op13_personal_data": personal_data.op13_personal_data,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filters.ORACLE,
        "op5_decontaminate": decontaminate.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op8_chat_preference": chat_preference.ORACLE,
        "op9_license_scan": license_scan.ORACLE,
        "op11_spelling_variants": spelling_variants.ORACLE,
        "op12_collocations": collocations.ORACLE,
        "op13_personal_data": personal_data.ORACLE,
    }
