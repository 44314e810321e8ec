"""Queries of the subpackage and their SQL, for the entry module."""

from . import op1_suffix, op10_decontam, op2_quality, op3_recompression, op4_pii, op5_toxicity, op6_packing, op7_minhash, op8_topk, op9_langid

QUERIES = {
    "op1_suffix_dedup": op1_suffix.op1_suffix_dedup,
    "op2_quality": op2_quality.op2_quality,
    "op3_recompression": op3_recompression.op3_recompression,
    "op4_pii": op4_pii.op4_pii,
    "op5_toxicity": op5_toxicity.op5_toxicity,
    "op6_packing": op6_packing.op6_packing,
    "op7_minhash": op7_minhash.op7_minhash,
    "op8_topk": op8_topk.op8_topk,
    "op9_language_id": op9_langid.op9_language_id,
    "op10_decontaminate": op10_decontam.op10_decontaminate,
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": op1_suffix.ORACLE,
    "op3_recompression": op3_recompression.ORACLE,
    "op7_minhash": op7_minhash.ORACLE,
    "op8_topk": op8_topk.ORACLE,
    "op10_decontaminate": op10_decontam.ORACLE,
}
