"""Registered queries: streaming forms (T1-T6), driven over the events
table as a landing folder with ``trigger(availableNow=True)``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators.cleaning import only_kind
from tremor.operators.geo import nearest_centre, scaler_stats
from tremor.plans.catalog import register
from tremor.plans.q_zones import ZONED_SQL
from tremor.plans.report import finalize, r6, tstr
from tremor.plans.sqlparts import WITH_QUAKE, weekly_rollup_sql
from tremor.plans.zones import DEFAULT_CENTRES
from tremor.session import materialize
from tremor.sources.tables import load_table
from tremor.sources.views import quake, quake_rows
from tremor.streaming.state import MEDIAN_RANK_ERROR, ZONES_ERROR, exact_weeks, sketch_check, stream_scaled, stream_weeks
from tremor.streaming.events import (run_available, sliding_counts, stream_dedup, stream_events,
                                     stream_place, stream_upsert, stream_weekly, with_event_time)


def _stream_quakes(spark, sf_dir):
    schema = load_table(spark, sf_dir, "events").schema
    ev = stream_events(spark, sf_dir, schema, pattern="events.parq*")
    return with_event_time(quake_rows(ev))


@register("T1_T2_stream_dedup", f"""{WITH_QUAKE} SELECT id, any_value(type) AS type FROM quake GROUP BY id""")
def q_stream_dedup(spark, sf_dir):
    """File-stream ingest of the events folder, watermarked dedup by id."""
    out = run_available(stream_dedup(_stream_quakes(spark, sf_dir)).select("id", "type"), stream_place(spark, "t2"))
    return finalize(out)


@register("T3_stream_weekly", f"""{WITH_QUAKE},
    e AS (SELECT * FROM quake WHERE type = 'earthquake'),
    wm AS (SELECT max(time_utc) - INTERVAL 1 DAY AS wm FROM e)
    SELECT strftime(CAST(date_trunc('week', time_utc) AS DATE), '%Y-%m-%d') AS week_start, count(*) AS nb_seismes,
           {r6('max(mag)')} AS mag_max
    FROM e, wm GROUP BY 1, wm.wm HAVING CAST(date_trunc('week', min(time_utc)) AS DATE) + 7 <= wm.wm""")
def q_stream_weekly(spark, sf_dir):
    """Monday weeks counted by a watermarked stream (append mode): only closed
    weeks are emitted, and they equal the batch rollup."""
    s = only_kind(_stream_quakes(spark, sf_dir))
    return finalize(run_available(stream_weekly(s, delay="1 day"), stream_place(spark, "t3")))


@register("T4_sliding_24h", f"""{WITH_QUAKE},
    b AS (SELECT time_bucket(INTERVAL 6 HOUR, time_utc) AS b0 FROM quake WHERE time_utc IS NOT NULL),
    w AS (SELECT b0 - k * INTERVAL 6 HOUR AS ws FROM b, (SELECT unnest(range(0, 4)) AS k) ks)
    SELECT {tstr('ws')} AS window_start, {tstr("ws + INTERVAL 24 HOUR")} AS window_end, count(*) AS n
    FROM w GROUP BY ws""")
def q_sliding(spark, sf_dir):
    """24-hour windows sliding every 6 hours (batch form of the stream)."""
    return finalize(sliding_counts(quake(spark, sf_dir).where(F.col("time_utc").isNotNull())))


@register("T4_sliding_7d", f"""{WITH_QUAKE},
    b AS (SELECT time_bucket(INTERVAL 1 DAY, time_utc) AS b0 FROM quake WHERE time_utc IS NOT NULL),
    w AS (SELECT b0 - k * INTERVAL 1 DAY AS ws FROM b, (SELECT unnest(range(0, 7)) AS k) ks)
    SELECT {tstr('ws')} AS window_start, {tstr("ws + INTERVAL 7 DAY")} AS window_end, count(*) AS n
    FROM w GROUP BY ws""")
def q_sliding_week(spark, sf_dir):
    """7-day look-back windows sliding daily."""
    return finalize(sliding_counts(quake(spark, sf_dir).where(F.col("time_utc").isNotNull()), length="7 days", slide="1 day"))


@register("T5_stream_upsert", f"""{WITH_QUAKE}
    SELECT strftime(CAST(date_trunc('week', time_utc) AS DATE), '%Y-%m-%d') AS week_start, count(*) AS nb_seismes,
           {r6('max(mag)')} AS mag_max
    FROM quake WHERE type = 'earthquake' GROUP BY 1""")
def q_stream_upsert(spark, sf_dir):
    """Update-mode weekly rollup upserted per micro-batch into a Parquet
    table partitioned by week (restated periods replace their rows)."""
    s = only_kind(_stream_quakes(spark, sf_dir)).withWatermark("time_utc", "7 days")
    agg = (s.groupBy(F.window("time_utc", "7 days", startTime="4 days").alias("w"))
           .agg(F.count(F.lit(1)).alias("nb_seismes"), F.max("mag").alias("mag_max"))
           .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("week_start"), "nb_seismes", "mag_max"))
    return finalize(stream_upsert(agg, stream_place(spark, "t5"), "week_start").select("week_start", "nb_seismes", "mag_max"))


@register("T6_stream_zones", f"""{ZONED_SQL} SELECT id, CAST(zone AS BIGINT) AS zone FROM zoned""")
def q_stream_zones(spark, sf_dir):
    """Stream-static zone assignment: scales from the batch table (one row,
    broadcast), nearest of the ten centres per streamed event."""
    stats = scaler_stats(only_kind(quake(spark, sf_dir))).select("latitude_sd", "longitude_sd")
    s = only_kind(_stream_quakes(spark, sf_dir)).join(F.broadcast(stats), on=F.lit(True), how="inner")
    zoned = s.select("id", nearest_centre(F.col("latitude"), F.col("longitude"), DEFAULT_CENTRES,
                                          F.col("latitude_sd"), F.col("longitude_sd")).alias("zone"))
    return finalize(run_available(zoned, stream_place(spark, "t6")))


@register("T3_T5_A1_week_state", f"""{WITH_QUAKE}, e AS (SELECT * FROM quake WHERE type = 'earthquake'), r AS ({weekly_rollup_sql('e')})
    SELECT strftime(date, '%Y-%m-%d') AS date, nb_seismes, {r6('mag_max')} AS mag_max, {r6('mag_mean')} AS mag_mean, {r6('depth_mean')} AS depth_mean,
           tsunami_sum, {r6('ln(1 + energy_sum)')} AS log1p_energy, nb_zones AS exact_zones, {r6('mag_median')} AS exact_median,
           1 AS zones_within_error, 1 AS median_within_error FROM r""")
def q_week_state(spark, sf_dir):
    """Weeks merged from the stream's mergeable parts, beside the exact mode:
    exact columns equal the batch rollup, and both sketches keep their stated
    error."""
    events = only_kind(_stream_quakes(spark, sf_dir))
    rows = materialize(stream_weeks(events, stream_place(spark, "week-state")))
    batch = only_kind(quake(spark, sf_dir))
    exact = materialize(exact_weeks(batch, rows))
    told = sketch_check(rows, exact, batch).drop("mag_median", "nb_zones").join(
        exact.select("date", F.col("nb_zones").alias("exact_zones"), F.col("mag_median").alias("exact_median")), "date")
    within = (F.col("rank_below") <= 0.5 + MEDIAN_RANK_ERROR) & (F.col("rank_within") >= 0.5 - MEDIAN_RANK_ERROR)
    return finalize(told.select(
        "date", "nb_seismes", "mag_max", "mag_mean", "depth_mean", "tsunami_sum", F.log1p("energy_sum").alias("log1p_energy"), "exact_zones",
        "exact_median", (F.col("zones_error") <= ZONES_ERROR).alias("zones_within_error"), F.coalesce(within, F.lit(True)).alias("median_within_error")))


@register("T6_stream_following_scales", f"""{ZONED_SQL} SELECT id, CAST(zone AS BIGINT) AS zone FROM zoned""")
def q_stream_following_scales(spark, sf_dir):
    """Zone assignment with scales that follow the stream: moments kept as
    versioned state; with all events in one batch they equal the batch scales."""
    def assign(rows):
        return rows.select("id", nearest_centre(F.col("latitude"), F.col("longitude"), DEFAULT_CENTRES,
                                                F.col("latitude_sd"), F.col("longitude_sd")).alias("zone"))
    return finalize(stream_scaled(only_kind(_stream_quakes(spark, sf_dir)), stream_place(spark, "t6-state"), assign).drop("batch"))
