"""All named queries over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.plans import entry_queries, flag_queries, graph_queries, lookup_queries, model_queries, motif_queries, motion_queries, node_queries, numeric_queries, reading_queries, registry, repair_queries, report_queries, scan_queries, series_queries, shape_queries, stat_queries, state_queries, track_queries, turn_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
