"""Every query of the library by name, with its DuckDB equivalent."""

from codeatlas.plans import clone_queries, code_queries, coordination_queries, flow_queries, graph_queries, history_queries, ladder_queries, module_queries, path_queries, plan_queries, review_queries, stream_queries, text_queries

_ALL = (graph_queries, code_queries, text_queries, history_queries, stream_queries, clone_queries, flow_queries, path_queries, module_queries, plan_queries, coordination_queries, ladder_queries, review_queries)
QUERIES: dict = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _ALL for k, v in m.ORACLE_SQL.items()}
