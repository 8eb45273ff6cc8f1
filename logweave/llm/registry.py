"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import collocations, exact_dedup, html_extraction, licenses, mixing, near_dedup, packing, periodic_runs, pii, quality_classifier, quality_rules, secrets, warc


def queries() -> dict:
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_mixing": mixing.op2_mixing,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_warc": warc.op5_warc,
        "op6_secrets": secrets.op6_secrets,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_html_extraction": html_extraction.op8_html_extraction,
        "op9_packing": packing.op9_packing,
        "op10_licenses": licenses.op10_licenses,
        "op11_collocations": collocations.op11_collocations,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_pii": pii.op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op5_warc": warc.OP5_SQL, "op11_collocations": collocations.OP11_SQL}
