"""All queries of the engine, by name, and their SQL."""

from __future__ import annotations

from cubeloom.plans import cube_queries, design_queries, sequence_queries, source_queries, stat_queries, stream_queries, tree_queries
from cubeloom.plans.registry import ORACLES, QUERIES

MODULES = (cube_queries, tree_queries, stat_queries, sequence_queries, stream_queries, design_queries, source_queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
