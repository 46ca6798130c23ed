"""Registered queries: file sources and sinks as round trips through the
shared checkpoint folder (S1, S5, S6, S7, S8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.operators.common import attach_row
from tremor.operators.rollup import weekly_rollup
from tremor.plans.catalog import register
from tremor.plans.q_monitor import FORECAST_SQL, rolling_mean_forecast
from tremor.plans.q_weekly import log_energy_report
from tremor.plans.report import dstr, finalize, r6, tstr
from tremor.plans.sqlparts import WITH_LONG, WITH_QUAKE, filled_weekly_sql, wk
from tremor.plans.weekly import weekly_series
from tremor.session import checkpoint_dir, materialize
from tremor.sources import files as FS
from tremor.sources import quarantine as QU
from tremor.sources.documents import ordered_records, write_document
from tremor.sources.views import quake, quake_long


def _scratch(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@register("S1_S6_geojson_roundtrip", f"""{WITH_QUAKE}
    SELECT CAST(id AS VARCHAR) AS id, {tstr('epoch_ms(epoch_us(time_utc) // 1000)')} AS time_utc,
           {r6('longitude')} AS longitude, {r6('latitude')} AS latitude, {r6('depth_km')} AS depth_km,
           {r6('mag')} AS mag, place, CAST(tsunami AS BIGINT) AS tsunami, CAST(sig AS BIGINT) AS sig, net,
           CAST(nst AS BIGINT) AS nst, {r6('dmin')} AS dmin, {r6('rms')} AS rms, {r6('gap')} AS gap, type
    FROM quake""")
def q_geojson(spark, sf_dir):
    """Write the catalogue as GeoJSON FeatureCollections (bounded batches),
    read it back with the GeoJSON scan: nested properties flattened,
    coordinates split, epoch milliseconds converted."""
    path = _scratch(spark, "geojson")
    FS.to_geojson_lines(quake(spark, sf_dir)).write.mode("overwrite").text(path)
    ev = FS.read_geojson(spark, path, multiline=False)
    return finalize(ev.select("id", "time_utc", "longitude", "latitude", "depth_km", "mag", "place", "tsunami",
                              "sig", "net", "nst", "dmin", "rms", "gap", "type"))


@register("S1_S8_quarantine", f"""{WITH_QUAKE}
    SELECT count(*) AS events, count(DISTINCT id) AS ids, {r6('sum(mag)', 4)} AS mag_sum, CAST(sum(sig) AS BIGINT) AS sig_sum, 1 AS broken_found FROM quake""")
def q_quarantine(spark, sf_dir):
    """The catalogue as GeoJSON documents, each followed by a copy cut in half:
    every event is read once, every cut copy is in the quarantine table."""
    feed, held = _scratch(spark, "feed"), _scratch(spark, "quarantine")
    docs = FS.to_geojson_lines(quake(spark, sf_dir))
    halves = F.array("value", F.expr("left(value, length(value) div 2)"))
    docs.select(F.explode(halves).alias("value")).write.text(feed)
    events = QU.read_geojson_safely(spark, feed, held, lines=True)
    told = events.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("id").alias("ids"), F.sum("mag").alias("mag_sum"), F.sum("sig").alias("sig_sum"))
    broken = spark.read.parquet(held).where("reason = 'not JSON'").agg(F.count(F.lit(1)).alias("broken"))
    lines = spark.read.text(feed).agg(F.count(F.lit(1)).alias("lines"))
    out = attach_row(attach_row(told, broken), lines).withColumn("broken_found", F.col("broken") * 2 == F.col("lines"))
    return finalize(out.drop("broken", "lines"), 4)


HISTORY_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("nb_seismes", T.LongType()),
    T.StructField("mag_max", T.DoubleType()), T.StructField("mag_mean", T.DoubleType()),
    T.StructField("mag_median", T.DoubleType()), T.StructField("depth_mean", T.DoubleType()),
    T.StructField("tsunami_sum", T.LongType()), T.StructField("nb_zones", T.LongType()),
    T.StructField("energy_sum", T.DoubleType())])


@register("S5_S6_csv_history_roundtrip", f"""{WITH_LONG},
    w AS (SELECT {wk('time_utc', 'iso_end')} AS date, count(id) AS nb_seismes, max(mag) AS mag_max,
                 avg(mag) AS mag_mean, median(mag) AS mag_median, avg(depth_km) AS depth_mean,
                 CAST(sum(tsunami) AS BIGINT) AS tsunami_sum, count(DISTINCT place) AS nb_zones,
                 sum(pow(10.0, 1.5 * mag)) AS energy_sum FROM quake_long WHERE time_utc IS NOT NULL GROUP BY 1)
    SELECT {dstr('date')} AS date, nb_seismes, {r6('mag_max')} AS mag_max, {r6('mag_mean')} AS mag_mean,
           {r6('mag_median')} AS mag_median, {r6('depth_mean')} AS depth_mean, tsunami_sum, nb_zones,
           {r6('ln(1 + energy_sum)')} AS log1p_energy_sum FROM w""")
def q_csv(spark, sf_dir):
    """Weekly history (Sunday labels) written as CSV and read back with an
    explicit schema (dates parsed by type)."""
    path = _scratch(spark, "history-csv")
    FS.write_csv(weekly_rollup(quake_long(spark, sf_dir), mode="iso_end"), path)
    return finalize(log_energy_report(FS.read_csv(spark, path, HISTORY_SCHEMA)))


FORECAST_DOC_SCHEMA = T.StructType([
    T.StructField("next_week_start", T.StringType()),
    T.StructField("prediction", T.StructType([T.StructField("central", T.IntegerType()),
                                              T.StructField("low", T.IntegerType()),
                                              T.StructField("high", T.IntegerType())])),
    T.StructField("history_12w", T.ArrayType(T.StructType([T.StructField("date", T.StringType()),
                                                           T.StructField("nb_seismes", T.LongType())])))])


@register("S7_S8_forecast_document", f"""{WITH_LONG}, {filled_weekly_sql()}, {FORECAST_SQL},
    h AS (SELECT date, nb_seismes FROM filled ORDER BY date DESC LIMIT 12)
    SELECT {dstr('next_week_start')} AS next_week_start, CAST(central AS BIGINT) AS central,
           CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high,
           (SELECT count(*) FROM h) AS n_history, (SELECT {dstr('min(date)')} FROM h) AS first_history_date,
           (SELECT CAST(sum(nb_seismes) AS BIGINT) FROM h) AS history_total
    FROM fc2""")
def q_forecast_doc(spark, sf_dir):
    """Forecast document (S7: header + ordered 12-week history) written as
    JSON, read back with a declared nested schema and unpacked (S8)."""
    weekly = materialize(weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes"))
    fc = rolling_mean_forecast(weekly)
    last12 = weekly.orderBy(F.desc("date")).limit(12).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "nb_seismes")
    hist = last12.agg(ordered_records(last12, ["date", "nb_seismes"], [("date", False)]).alias("history_12w"))
    doc = attach_row(fc, hist).select(
        F.date_format("next_week_start", "yyyy-MM-dd").alias("next_week_start"),
        F.struct("central", "low", "high").alias("prediction"), "history_12w")
    path = _scratch(spark, "forecast-doc")
    write_document(doc, path)
    back = FS.read_document(spark, path, FORECAST_DOC_SCHEMA)
    h = F.col("history_12w")
    return finalize(back.select(
        "next_week_start", F.col("prediction.central").cast("bigint").alias("central"),
        F.col("prediction.low").cast("bigint").alias("low"), F.col("prediction.high").cast("bigint").alias("high"),
        F.size(h).cast("bigint").alias("n_history"), h[0]["date"].alias("first_history_date"),
        F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: acc + x["nb_seismes"]).alias("history_total")))



@register("S6_S2_partitioned_event_table", f"""{WITH_LONG}
    SELECT id, {tstr('time_utc')} AS time_utc, {r6('mag')} AS mag, CAST(zone AS BIGINT) AS zone
    FROM quake_long WHERE time_utc >= TIMESTAMP '1997-03-01' AND time_utc < TIMESTAMP '1998-07-15'""")
def q_partitioned(spark, sf_dir):
    """The catalogue written as a month-partitioned table, then a time-range
    scan that prunes partitions (month filter) and pushes the exact bound."""
    path = _scratch(spark, "events-by-month")
    FS.write_event_table(quake_long(spark, sf_dir), path)
    ev = FS.read_event_table(spark, path, "1997-03-01", "1998-07-15")
    return finalize(ev.select("id", "time_utc", "mag", "zone"))
