"""All queries of the engine outside the text subpackage, with their SQL."""

from __future__ import annotations

from loomgraph.plans import eval_queries, graph_queries, model_queries, problems, search_queries, table_queries, text_queries

FLAGSHIP = "vec_topk"
_MODULES = [problems, text_queries, search_queries, graph_queries, table_queries, eval_queries, model_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
