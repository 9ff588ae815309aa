"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import ann, bpe, decontaminate, filter_audit, jaccard, lattice_lm, licenses, quality, resample, secrets, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_quality": quality.op2_quality,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_bpe": bpe.op6_bpe,
    "op7_secrets": secrets.op7_secrets,
    "op8_licenses": licenses.op8_licenses,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_lattice_lm": lattice_lm.op11_lattice_lm,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_resample": resample.op13_resample,
}

ORACLE_SQL = {
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op10_jaccard": jaccard.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_resample": resample.ORACLE_SQL,
}
