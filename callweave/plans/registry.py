"""Names of the code-graph queries and their DuckDB counterparts."""

from __future__ import annotations

from callweave.plans import context_queries, table_queries  # noqa: F401
from callweave.plans import queries as graph

FLAGSHIP = "get_callees"


def queries() -> dict:
    return dict(graph.QUERIES)


def oracle_sql() -> dict:
    return dict(graph.ORACLES)
