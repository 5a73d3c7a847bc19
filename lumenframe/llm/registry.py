"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_cnn, context_mixing, decontaminate, language_id, order_minhash, packing, pseudonyms, quality_rules, section_tokens, wavelet

QUERIES = {
    "op1_wavelet": wavelet.op1_wavelet,
    "op2_language_id": language_id.op2_language_id,
    "op3_order_minhash": order_minhash.op3_order_minhash,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_pseudonyms": pseudonyms.op5_pseudonyms,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_packing": packing.op7_packing,
    "packing_examples": packing.op7_examples,
    "op8_byte_cnn": byte_cnn.op8_byte_cnn,
    "op9_section_tokens": section_tokens.op9_section_tokens,
    "op10_context_mixing": context_mixing.op10_context_mixing,
}
ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": decontaminate.OP4_SQL,
}
