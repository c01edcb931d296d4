"""Queries of the text operators and their SQL."""

from __future__ import annotations

from loomgraph.llm import queries_names, queries_texts

_MODULES = [queries_names, queries_texts]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
