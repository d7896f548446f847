"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import event_queries, graph_queries, inference_queries, merge_queries, report_queries, rule_queries, search_queries, source_queries, state_queries, stream_queries, visit_queries, whole_queries

_MODULES = (graph_queries, merge_queries, event_queries, stream_queries, whole_queries, rule_queries, search_queries, visit_queries, source_queries, report_queries, state_queries, inference_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
