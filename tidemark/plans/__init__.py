"""The operators bound to tables: named queries and the SQL they are checked against."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    """(queries by name, SQL by name) of all binding modules."""
    from tidemark.plans import analysis_queries, base, data_queries, metric_queries, partition_queries, selection_queries, stat_queries  # noqa: F401

    return base.QUERIES, base.ORACLE
