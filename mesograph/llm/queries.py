"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import audio, chat, languages, lines, mixing, pipeline, quality, rules, simhash, tokens, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_tokens": tokens.op2_tokens,
    "op3_audio": audio.op3_audio,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_languages": languages.op5_languages,
    "op6_chat": chat.op6_chat,
    "op7_rules": rules.op7_rules,
    "op8_quality": quality.op8_quality,
    "op9_lines": lines.op9_lines,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": pipeline.run,
}
ORACLE_SQL = {
    "op6_chat": chat.OP6_SQL,
    "op9_lines": lines.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
