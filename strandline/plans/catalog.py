"""Registered queries of the ordering library and the DuckDB SQL they are compared with."""

from __future__ import annotations

from strandline.plans import order_queries, qc_queries

_ALL = qc_queries.BY_NAME | order_queries.BY_NAME

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
