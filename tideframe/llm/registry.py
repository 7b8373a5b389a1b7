"""The corpus queries and their oracle SQL."""

from __future__ import annotations

from tideframe.llm import bpe, chat, embeddings, mixing, neardup, quality, secrets, substrings, tokenfiles, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_token_files": tokenfiles.op2_token_files,
    "op3_chat_repair": chat.op3_chat_repair,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_minhash": neardup.op6_minhash,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {
    "op1_secret_scan": secrets.OP1_SQL,
    "op6_minhash": neardup.OP6_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op8_embeddings": embeddings.OP8_SQL,
}
