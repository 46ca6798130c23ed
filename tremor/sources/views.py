"""Stand-in event catalogues built from the test tables.

These two views only map test-table rows onto the event schema the jobs
expect (definitions fixed in FIXTURES.md §3); they do none of the jobs'
work.  Expressions are written in SQL form so that decimal literals keep
the same exact arithmetic as the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.sources.tables import load_table

# Column definitions of the `quake` stand-in (FIXTURES.md §3.1).
QUAKE_EXPRS = {
    "id": "event_id",
    "time_utc": "ts",
    "mag": "CASE WHEN k % 13 = 0 THEN NULL ELSE 2 + ln(1 + value) END",
    "depth_km": "CAST(k * 7.5 AS DOUBLE)",
    "latitude": "CAST((user_id * 37) % 180 - 90 AS DOUBLE)",
    "longitude": "CAST((user_id * 91 + k * 7) % 360 - 180 AS DOUBLE)",
    "gap": "CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k * 3.6 AS DOUBLE) END",
    "rms": "CASE WHEN k % 11 = 0 THEN NULL ELSE value / 100 END",
    "nst": "CAST(CASE WHEN k % 5 = 0 THEN NULL ELSE k END AS INT)",
    "dmin": "value / 50",
    "sig": "CAST(k * 10 AS INT)",
    "tsunami": "CAST(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS INT)",
    "type": "CASE WHEN event_type = 'error' THEN 'quarry blast' ELSE 'earthquake' END",
    "net": "event_type",
    "place": "concat('place_', CAST(user_id % 50 AS STRING))",
}

# Column definitions of the `quake_long` stand-in (FIXTURES.md §3.2).
QUAKE_LONG_EXPRS = {
    "id": "o_orderkey",
    "time_utc": "o_orderdate",
    "mag": "2 + ln(1 + o_totalprice) / 2",
    "depth_km": "CAST((o_orderkey * 7) % 700 AS DOUBLE)",
    "tsunami": "CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS INT)",
    "place": "concat('c', CAST(o_custkey % 200 AS STRING))",
    "zone": "CAST(c_nationkey AS INT)",
    "latitude": "CAST((c_nationkey * 37) % 180 - 90 AS DOUBLE)",
    "longitude": "CAST((c_nationkey * 91) % 360 - 180 AS DOUBLE)",
}


def quake_rows(events: DataFrame) -> DataFrame:
    """Map `events` rows (batch or stream) onto the event schema."""
    ev = events.withColumn("k", F.expr("CAST(get_json_object(props, '$.k') AS INT)"))
    return ev.select([F.expr(e).alias(c) for c, e in QUAKE_EXPRS.items()])


def quake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-level catalogue (30 days, planted nulls) over `events`."""
    return quake_rows(load_table(spark, sf_dir, "events"))


def quake_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (345-week), zone-level catalogue over `orders ⋈ customer`.

    The join is left to Catalyst/AQE: customer grows with the data, so no
    broadcast is forced; AQE converts it at run time when the side is small.
    """
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                                        "o_totalprice", "o_orderdate")
    cust = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
    return joined.select([F.expr(e).alias(c) for c, e in QUAKE_LONG_EXPRS.items()])


# DuckDB forms of the same views, used by the oracle SQL.
QUAKE_SQL = (
    "quake AS (SELECT " + ", ".join(
        f"{e.replace('AS STRING', 'AS VARCHAR').replace('AS INT)', 'AS INTEGER)')} AS {c}"
        for c, e in QUAKE_EXPRS.items())
    + " FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"
)
QUAKE_LONG_SQL = (
    "quake_long AS (SELECT " + ", ".join(
        f"{e.replace('AS STRING', 'AS VARCHAR').replace('AS INT)', 'AS INTEGER)')} AS {c}"
        for c, e in QUAKE_LONG_EXPRS.items())
    + " FROM orders JOIN customer ON o_custkey = c_custkey)"
)
