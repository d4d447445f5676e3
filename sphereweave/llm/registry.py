"""Queries of the training-data operators, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from . import decontaminate, embed_dedup, langid, license_scan, lm_score, minhash, mixing, pii, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_embed_dedup": embed_dedup.op3_embed_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_minhash": minhash.op5_minhash,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_langid": langid.op7_langid,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_pii": pii.op9_pii,
    "op10_warc": warc.op10_warc,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op3_embed_dedup": embed_dedup.ORACLE,
    "op6_license_scan": license_scan.oracle(),
    "op8_decontaminate": decontaminate.ORACLE,
    "op10_warc": warc.ORACLE,
}
