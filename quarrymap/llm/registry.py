"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from quarrymap.llm import bpe, decontaminate, extract, licenses, outliers, pii, quality, secrets, simhash, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_secrets": secrets.op2_secrets,
    "op3_pii": pii.op3_pii,
    "op4_simhash": simhash.op4_simhash,
    "op5_extract": extract.op5_extract,
    "op6_urls": urls.op6_urls,
    "op7_quality": quality.op7_quality,
    "op8_quality_rules": outliers.op8_quality_rules,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_licenses": licenses.op10_licenses,
}
ORACLES = {
    "op6_urls": urls.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
}
