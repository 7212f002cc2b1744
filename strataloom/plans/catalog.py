"""Every registered query with its DuckDB equivalent."""

from strataloom.plans import change_queries, evaluation_queries, evidence_queries, graph_queries, mining_queries, packet_queries, source_queries, text_queries  # noqa: F401
from strataloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
