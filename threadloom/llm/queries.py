"""All training-data queries with their SQL, by name."""

from __future__ import annotations

from threadloom.llm import q_abuse, q_overlap, q_pairs, q_spam, q_splits, q_tokens

_MODULES = (q_pairs, q_splits, q_overlap, q_abuse, q_tokens, q_spam)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
