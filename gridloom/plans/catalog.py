"""Every named query of the library, with the SQL that DuckDB compares it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


from gridloom.plans import audit_queries, dataset_queries, field_queries, manifest_queries, metric_queries, mosaic_queries, raster_queries, sampling_queries, scene_queries, stream_queries  # noqa: E402,F401  registers its queries
