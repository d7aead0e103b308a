"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from leafgrid.llm import ann, chat, line_dedup, mixing, ngram_join, pii, quality, sentencepiece_codec, sharding, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_nearest": ann.op2_nearest,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_mixing": mixing.op4_mixing,
    "op5_chat_format": chat.op5_chat_format,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_sharding": sharding.op7_sharding,
    "op8_pii": pii.op8_pii,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_nearest": ann.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op7_sharding": sharding.op7_sql(),
    "op9_quality_rules": quality.OP9_SQL,
}
