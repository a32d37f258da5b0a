"""Queries of the training-data operators over the documents, pages and conversations tables."""

from __future__ import annotations

from .conversation_trie import op12_conversation_trie
from .exact_dedup import op9_exact_dedup
from .language_id import op7_language_id
from .line_quality import op6_line_quality
from .merkle import op13_merkle_manifest
from .oracle import ORACLE_SQL
from .packing import op3_best_fit_packing
from .personal_data import op5_personal_data
from .sentence_pieces import op4_sentence_pieces
from .simhash import op10_simhash
from .substring_dedup import op2_substring_dedup
from .token_blocks import op1_token_blocks
from .url_filter import op11_url_filter
from .warc import op8_warc

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_token_blocks": op1_token_blocks,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_sentence_pieces": op4_sentence_pieces,
    "op5_personal_data": op5_personal_data,
    "op6_line_quality": op6_line_quality,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash": op10_simhash,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}
