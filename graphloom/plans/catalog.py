"""All registered queries of the code-graph operators and their SQL oracles."""

from __future__ import annotations

from graphloom.plans import answer_queries, family_queries, graph_queries, link_queries, relation_queries, report_queries, scalars, site_queries, source_queries, text_queries  # noqa: F401
from graphloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
