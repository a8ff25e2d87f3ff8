"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quillmark.llm import ann, classifier, collocations, fingerprint, license_scan, line_dedup, mixing, near_dedup, packing, pii, quality, resample, substring_dedup

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_nearest": ann.op3_nearest,
    "op4_pii": pii.op4_pii,
    "op5_quality_classifier": classifier.op5_quality_classifier,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_pack": packing.op7_pack,
    "op8_mix": mixing.op8_mix,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_fingerprints": fingerprint.op11_fingerprints,
    "op12_collocations": collocations.op12_collocations,
    "op13_resample": resample.op13_resample,
}

SQL = {
    "op2_license_scan": license_scan.SQL,
    "op8_mix": mixing.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op12_collocations": collocations.SQL,
}
