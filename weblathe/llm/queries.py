"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from weblathe.llm import exact_dedup, filter_audit, jaccard_join, license_scan, mixing, packing, pieces, quality_model, quality_rules, site_style, source_divergence, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_site_style": site_style.query,
        "op4_pieces": pieces.query,
        "op5_license_scan": license_scan.query,
        "op6_quality_rules": quality_rules.query,
        "op7_token_counts": token_counts.query,
        "op8_mixing": mixing.query,
        "op9_quality_model": quality_model.query,
        "op10_jaccard_join": jaccard_join.query,
        "op11_packing": packing.query,
        "op12_filter_audit": filter_audit.query,
        "op13_source_divergence": source_divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE_SQL,
        "op2_exact_dedup": exact_dedup.ORACLE_SQL,
        "op5_license_scan": license_scan.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op12_filter_audit": filter_audit.ORACLE_SQL,
        "op13_source_divergence": source_divergence.ORACLE_SQL,
    }
