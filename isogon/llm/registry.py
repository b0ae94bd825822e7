"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from isogon.llm import bpe, embeddings, langid, linededup, mixing, packed, quality, sharding, simhash, substrings

QUERIES = {
    "op1_token_binary": packed.op1,
    "op2_line_dedup": linededup.op2,
    "op3_sharding": sharding.op3,
    "op4_language_id": langid.op4,
    "op5_embedding_neardup": embeddings.op5,
    "op6_quality_rules": quality.op6,
    "op7_source_mixing": mixing.op7,
    "op8_simhash": simhash.op8,
    "op9_byte_bpe": bpe.op9,
    "op10_substring_dedup": substrings.op10,
}

ORACLE_SQL = {"op7_source_mixing": mixing.ORACLE}
