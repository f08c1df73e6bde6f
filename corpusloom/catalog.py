"""Every query of this package by name, and its SQL."""

from __future__ import annotations

from corpusloom.plans import corpus_queries, kernels, model_queries, store_queries

_MODULES = (corpus_queries, kernels, model_queries, store_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
