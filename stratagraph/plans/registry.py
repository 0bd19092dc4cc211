"""All queries of the core, and their SQL."""

from __future__ import annotations

from . import p4, q_cypher, q_graph, q_planted, q_stream, q_tables

MODULES = [p4, q_graph, q_tables, q_stream, q_cypher, q_planted]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
