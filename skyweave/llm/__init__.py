"""Operators of a large-scale training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyweave.llm import bpe_codec, decontaminate, exact_dedup, fill_in_middle, html_extract, license_scan, near_dedup, pii, quality_rules, ranked_search, substring_dedup, token_count, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_pii": pii.op3_pii,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_token_count": token_count.op5_token_count,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_html_extract": html_extract.op8_html_extract,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_bpe_codec": bpe_codec.op10_bpe_codec,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.ORACLE_SQL,
        "op4_quality_rules": quality_rules.ORACLE_SQL,
        "op6_near_dedup": near_dedup.ORACLE_SQL,
        "op9_substring_dedup": substring_dedup.ORACLE_SQL,
        "op11_ranked_search": ranked_search.ORACLE_SQL,
        "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
        "op13_exact_dedup": exact_dedup.ORACLE_SQL,
    }
