"""All registered queries of the engine, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import geometry_queries, raster_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = geometry_queries.QUERIES | raster_queries.QUERIES
ORACLES: dict[str, str] = geometry_queries.ORACLES | raster_queries.ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["classified_segments"](spark, sf_dir)
