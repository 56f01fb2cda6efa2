"""All registered queries of the radar engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beamgrid.plans import file_queries, radar_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return radar_queries.QUERIES | file_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return radar_queries.SQL | file_queries.SQL
