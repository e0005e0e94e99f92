"""All queries of the core by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import life_queries, metric_queries, run_queries, signal_queries, stage_queries, turn_queries

PARTS = (turn_queries, signal_queries, stage_queries, run_queries, life_queries, metric_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for p in PARTS for n, f in p.QUERIES.items()}
SQL: dict[str, str] = {n: s for p in PARTS for n, s in p.SQL.items()}
FLAGSHIP = "final_selection"
