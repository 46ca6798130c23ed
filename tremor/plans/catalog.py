"""Registry of named queries and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the
whole stand-in catalogue derived from the test tables; ``ORACLE[name]`` is
an independent SQL formulation over the same parquet tables.  Queries
without a SQL twin (model fits, sampling, per-series recursions) are
checked by invariants in ``tests/``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def pin_utc(spark: SparkSession) -> None:
    """Event times are UTC: week labels, epoch conversions and stream
    windows must not depend on the caller's session time zone."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from tremor.plans import (q_weekly, q_scalars, q_aggregates, q_windows,  # noqa: F401
                              q_zones, q_monitor, q_tables, q_impute, q_models,
                              q_series, q_stream, q_io)
