"""Registered queries: current-week snapshot (A2), period upsert (S10/J6),
metric history (S13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators import stats as ST
from tremor.operators.cleaning import only_kind
from tremor.operators.rollup import week_snapshot, weekly_rollup
from tremor.plans.catalog import register
from tremor.plans.q_weekly import log_energy_report
from tremor.plans.q_windows import _BASE_SQL, baseline_predictions
from tremor.plans.report import dstr, finalize, r6
from tremor.plans.sqlparts import WITH_QUAKE, wk
from tremor.session import materialize
from tremor.sources.history import freshness, latest_metrics, upsert_period
from tremor.sources.tables import load_table
from tremor.sources.views import quake

AS_OF = "2024-01-29 12:00:00"

SNAPSHOT_SQL = f"""s AS (SELECT CAST(date_trunc('week', TIMESTAMP '{AS_OF}') AS DATE) + 6 AS date,
        count(*) AS nb_seismes, coalesce(max(mag), 0.0) AS mag_max, coalesce(avg(mag), 0.0) AS mag_mean,
        coalesce(median(mag), 0.0) AS mag_median, coalesce(avg(depth_km), 0.0) AS depth_mean,
        CAST(coalesce(sum(coalesce(tsunami, 0)), 0) AS BIGINT) AS tsunami_sum, count(DISTINCT place) AS nb_zones,
        coalesce(sum(pow(10.0, 1.5 * coalesce(mag, 0.0))), 0.0) AS energy_sum
    FROM quake WHERE time_utc >= date_trunc('week', TIMESTAMP '{AS_OF}')
      AND time_utc < date_trunc('week', TIMESTAMP '{AS_OF}') + INTERVAL 7 DAY AND type = 'earthquake')"""

_COLS = (f"{dstr('date')} AS date, nb_seismes, {r6('mag_max')} AS mag_max, {r6('mag_mean')} AS mag_mean, "
         f"{r6('mag_median')} AS mag_median, {r6('depth_mean')} AS depth_mean, tsunami_sum, nb_zones, "
         f"{r6('ln(1 + energy_sum)')} AS log1p_energy_sum")


@register("A2_S9_week_snapshot", f"""{WITH_QUAKE}, {SNAPSHOT_SQL} SELECT {_COLS} FROM s""")
def q_snapshot(spark, sf_dir):
    """Single-row rollup of the Monday..Sunday week containing as_of (serving
    semantics: NULL magnitude counts as energy 1); zeros if empty."""
    return finalize(log_energy_report(week_snapshot(quake(spark, sf_dir), AS_OF, null_mag_as_zero=True)))


@register("S10_J6_upsert_week", f"""{WITH_QUAKE}, {SNAPSHOT_SQL},
    h AS (SELECT {wk('time_utc', 'iso_end')} AS date, count(id) AS nb_seismes, max(mag) AS mag_max,
                 avg(mag) AS mag_mean, median(mag) AS mag_median, avg(depth_km) AS depth_mean,
                 CAST(sum(tsunami) AS BIGINT) AS tsunami_sum, count(DISTINCT place) AS nb_zones,
                 sum(pow(10.0, 1.5 * mag)) AS energy_sum
          FROM quake WHERE type = 'earthquake' AND time_utc IS NOT NULL GROUP BY 1),
    u AS (SELECT * FROM h WHERE date NOT IN (SELECT date FROM s) UNION ALL SELECT * FROM s)
    SELECT {_COLS} FROM u""")
def q_upsert(spark, sf_dir):
    """Weekly history (Sunday labels) with the current week's row replaced by
    the fresh snapshot — anti join on the period + union."""
    events = quake(spark, sf_dir)
    history = weekly_rollup(only_kind(events), mode="iso_end")
    new = materialize(week_snapshot(events, AS_OF, null_mag_as_zero=True))      # read for its key and for the union
    return finalize(log_energy_report(upsert_period(history, new, "date")))


@register("S13_metric_history", f"""{_BASE_SQL},
    e AS (SELECT * FROM p WHERE y IS NOT NULL AND yhat IS NOT NULL),
    m AS (SELECT make_date(year(date), 12, 31) AS date, model, avg(abs(y - yhat)) AS mae,
                 sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
                 1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(y)) AS r2
          FROM e GROUP BY 1, 2),
    h AS (SELECT * FROM m UNION ALL
          SELECT max(date) + 7, model, NULL, NULL, NULL FROM m GROUP BY model)
    SELECT model, {dstr('max(date)')} AS latest_date, {r6('arg_max(mae, date) FILTER (mae IS NOT NULL)')} AS latest_mae,
           {r6('arg_max(rmse, date) FILTER (mae IS NOT NULL)')} AS latest_rmse, {r6('arg_max(r2, date) FILTER (mae IS NOT NULL)')} AS latest_r2,
           {r6('min(mae)')} AS best_mae, {dstr('arg_min(date, (mae, date)) FILTER (mae IS NOT NULL)')} AS best_date, count(*) AS runs
    FROM h GROUP BY model""")
def q_metric_history(spark, sf_dir):
    """Metric history (one evaluation per model and year of the hold-out, then
    a run of each model that recorded no metrics) and its latest / best run."""
    p = baseline_predictions(spark, sf_dir)
    hist = ST.regression_metrics(p, "y", "yhat", by=[F.make_date(F.year("date"), F.lit(12), F.lit(31)).alias("date"), "model"])
    hist = materialize(hist.select("date", "model", "mae", "rmse", "r2"))
    none = F.lit(None).cast("double")
    bare = hist.groupBy("model").agg(F.date_add(F.max("date"), 7).alias("date")).select(
        "date", "model", none.alias("mae"), none.alias("rmse"), none.alias("r2"))
    return finalize(latest_metrics(hist.unionByName(bare)))


@register("S12_run_freshness", """WITH log AS (
      SELECT event_type AS step, date_trunc('hour', ts) AS last_run, event_id AS seq,
             CASE WHEN value > 100 THEN 'failed' ELSE 'ok' END AS status, 'value ' || CAST(user_id AS VARCHAR) AS message FROM events)
    SELECT step, strftime(max(last_run), '%Y-%m-%d %H:%M:%S.%f') AS last_run, arg_max(status, (last_run, seq)) AS status,
           arg_max(message, (last_run, seq)) AS message, count(*) AS runs FROM log GROUP BY step""")
def q_run_freshness(spark, sf_dir):
    """Latest run per step of a log derived from the events (a run per event,
    many at the same hour: the run sequence decides)."""
    log = load_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("step"), F.date_trunc("hour", "ts").alias("last_run"), F.col("event_id").alias("seq"),
        F.when(F.col("value") > 100, "failed").otherwise("ok").alias("status"),
        F.concat(F.lit("value "), F.col("user_id").cast("string")).alias("message"))
    return finalize(freshness(log))
