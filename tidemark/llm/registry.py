"""Queries of the corpus operators, by name."""

from __future__ import annotations

from . import bm25, bpe, chat, decontaminate, html, ngram_join, pii, pipeline, quality, secrets, tokens, trie, whitening

QUERIES: dict = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_bm25": bm25.op3_bm25,
    "op4_html_text": html.op4_html_text,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_quality": quality.op6_quality,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_chat_format": chat.op9_chat_format,
    "op7_token_counts": tokens.op7_token_counts,
    "op10_packing": tokens.op10_packing,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_whitening": whitening.op12_whitening,
    "op13_byte_bpe": bpe.op13_byte_bpe,
    "pipeline": pipeline.run,
}
ORACLES: dict = {
    "op3_bm25": bm25.OP3_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
}
