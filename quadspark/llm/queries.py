"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, decontaminate, fingerprints, language_id, line_dedup, lm_scoring, mixing, near_dups, secrets, token_store

QUERIES = {
    "op1_token_ids": token_store.op1_token_ids,
    "op2_mixing": mixing.op2_mixing,
    "op3_near_dups": near_dups.op3_near_dups,
    "op4_language_id": language_id.op4_language_id,
    "op5_chat_format": chat.op5_chat_format,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_secrets": secrets.op9_secrets,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
}

ORACLES = {
    "op5_chat_format": chat.SQL,
    "op7_line_dedup": line_dedup.SQL,
}
