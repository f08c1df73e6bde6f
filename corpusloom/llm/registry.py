"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, chat, divergence, minhash, packing, quality, search, secret_scan, sharding, spelling, suffix_dedup, toxicity, url_filter

_MODULES = (quality, packing, url_filter, minhash, suffix_dedup, sharding, secret_scan, toxicity, bpe, search, divergence, chat, spelling)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
