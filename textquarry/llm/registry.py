"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, jaccard, licenses, packing, quality, secrets, substrings, token_files, urls, warc

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_arc_to_warc": warc.op2_arc_to_warc,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_license_scans": licenses.op6_license_scans,
    "op7_token_files": token_files.op7_token_files,
    "op8_suffix_array_dedup": substrings.op8_suffix_array_dedup,
    "op9_url_filters": urls.op9_url_filters,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLES = {
    "op1_secret_scans": secrets.oracle_op1,
    "op2_arc_to_warc": warc.oracle_op2,
    "op4_quality_rules": quality.oracle_op4,
    "op6_license_scans": licenses.oracle_op6,
    "op9_url_filters": urls.oracle_op9,
}


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, sql in ORACLES.items()}
