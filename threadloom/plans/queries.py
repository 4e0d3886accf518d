"""All queries of the core library with their SQL, by name."""

from __future__ import annotations

from threadloom.plans import corpora, hierarchies, operations, runs, texts

_MODULES = (hierarchies, texts, corpora, operations, runs)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
