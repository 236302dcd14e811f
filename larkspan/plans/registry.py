"""The named queries over the driver's tables and their SQL oracles.

Modules of this package register their queries on import.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` as ``name``, with the SQL that DuckDB checks it by."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


from larkspan.plans import (  # noqa: E402
    corpus_queries, duplicate_queries, extra_queries, graph_queries, history_queries, impact_queries, retrieval_queries, rule_queries,
    stream_queries, telemetry_queries, web_queries,
)

__all__ = [
    "QUERIES", "ORACLES", "query", "corpus_queries", "duplicate_queries", "extra_queries", "graph_queries", "impact_queries", "history_queries",
    "retrieval_queries", "rule_queries", "stream_queries", "telemetry_queries", "web_queries",
]
