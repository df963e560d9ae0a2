"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import blocks, chat, decontaminate, html, mixing, quality, simhash, suffixes, tokens, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_suffix_dedup": suffixes.query,
    "op3_chat_format": chat.query,
    "op4_warc": warc.query,
    "op5_block_dedup": blocks.query,
    "op6_quality_rules": quality.query,
    "op7_decontamination": decontaminate.query,
    "op8_html_text": html.query,
    "op9_simhash": simhash.query,
    "op10_token_shards": tokens.query,
    "quality_base": quality.base_query,  # the part of op6 that SQL can express
}
ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_block_dedup": blocks.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "quality_base": quality.BASE_ORACLE,
}
