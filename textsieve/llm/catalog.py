"""Registry of the subpackage's queries and their DuckDB oracles."""
from __future__ import annotations

from textsieve.llm import op1_language, op2_tokens, op3_jaccard, op4_fingerprint, op5_toxicity, op6_bpe, op7_vectors, op8_lines, op9_mixing, op10_html, op11_merkle, op12_alignment, op13_substrings

_MODULES = [op1_language, op2_tokens, op3_jaccard, op4_fingerprint, op5_toxicity, op6_bpe, op7_vectors, op8_lines, op9_mixing, op10_html, op11_merkle, op12_alignment, op13_substrings]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: sql for m in _MODULES for k, sql in getattr(m, "ORACLE", {}).items()}
