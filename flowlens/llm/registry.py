"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from flowlens.llm import audit, chat, decontaminate, fingerprints, ngram_join, pii, quality_model, quality_rules, repair, secrets, shards, tokens

QUERIES = {
    "op1_sentencepiece": tokens.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_token_counts": tokens.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_chat_formatting": chat.op5,
    "op6_quality_classifier": quality_model.op6,
    "op7_secret_scans": secrets.op7,
    "op8_token_shards": shards.op8,
    "op9_ngram_jaccard_join": ngram_join.op9,
    "op10_pii": pii.op10,
    "op11_conversation_repair": repair.op11,
    "op12_fingerprints": fingerprints.op12,
    "op13_filter_audit": audit.op13,
}
ORACLES = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op9_ngram_jaccard_join": ngram_join.OP9_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
