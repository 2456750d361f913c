"""All queries of the core, by name."""

from __future__ import annotations

from . import graph_queries, orphan_queries, pipeline_queries, search_queries, wiki_queries

MODULES = [orphan_queries, graph_queries, search_queries, wiki_queries, pipeline_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
