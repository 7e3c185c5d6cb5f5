"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import fingerprint, languagemodel, licenses, mixing, packing, pii, quality, simhash, suffixes, urls

QUERIES = {
    "op1_hilbert_packing": packing.op1,
    "op2_divergence_rules": quality.op2,
    "op3_license_scan": licenses.op3,
    "op4_url_filter": urls.op4,
    "op5_source_mix": mixing.op5,
    "op6_suffix_merge": suffixes.op6,
    "op7_weighted_fingerprint": fingerprint.op7,
    "op8_golay_simhash": simhash.op8,
    "op9_surrogate_pii": pii.op9,
    "op10_gru_scoring": languagemodel.op10,
}

ORACLES: dict[str, str] = {}
