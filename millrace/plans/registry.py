"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import evaluation, ingestion, posts, reporting, retrieval

Query = Callable[[SparkSession, str], DataFrame]

_ALL = retrieval.QUERIES | ingestion.QUERIES | evaluation.QUERIES | reporting.QUERIES | posts.QUERIES
QUERIES: dict[str, Query] = {name: fn for name, (fn, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
