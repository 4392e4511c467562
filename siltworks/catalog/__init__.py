"""The registered queries and, for each that SQL can express, the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.catalog import (
    anomaly_queries,
    cleaning_queries,
    detect_queries,
    feature_queries,
    investigate_queries,
    model_queries,
    profile_queries,
    runlog_queries,
    source_queries,
    stream_queries,
)

MODULES = (
    source_queries,
    profile_queries,
    anomaly_queries,
    investigate_queries,
    detect_queries,
    cleaning_queries,
    feature_queries,
    model_queries,
    runlog_queries,
    stream_queries,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
