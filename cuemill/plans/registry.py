"""Registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import artifact_queries, catalog_queries, recovery_queries, rule_queries, stream_queries, text_queries, timing_queries, workspace_queries

_PARTS = (catalog_queries, text_queries, timing_queries, workspace_queries, rule_queries, stream_queries, recovery_queries, artifact_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
