"""Registered queries: weekly monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions.scalars import nonneg_int
from tremor.operators.joins import compare_forecast
from tremor.plans.catalog import register
from tremor.plans.monitoring import anomaly, bar_lengths, week_on_week
from tremor.plans.report import dstr, finalize, r6
from tremor.plans.sqlparts import WITH_LONG, filled_weekly_sql
from tremor.plans.weekly import weekly_series
from tremor.session import materialize
from tremor.sources.views import quake_long

FILLED = f"{WITH_LONG}, {filled_weekly_sql()}"
LAST8 = f"{FILLED}, l8 AS (SELECT date, nb_seismes FROM filled ORDER BY date DESC LIMIT 8)"


def rolling_mean_forecast(weekly):
    """Forecast document fields from the 4-week-mean baseline with the fixed
    +-50 fallback interval (M10): one row (next_week_start, central, low, high)."""
    last4 = weekly.orderBy(F.desc("date")).limit(4)
    agg = last4.agg(F.avg("nb_seismes").alias("m"), F.max("date").alias("d"))
    central = nonneg_int(F.col("m"))
    return agg.select(F.date_add("d", 7).alias("next_week_start"), central.alias("central"),
                      F.greatest(central - 50, F.lit(0)).alias("low"), (central + 50).alias("high"))


FORECAST_SQL = f"""l4 AS (SELECT date, nb_seismes FROM filled ORDER BY date DESC LIMIT 4),
    fc AS (SELECT max(date) + 7 AS next_week_start, CAST(trunc(greatest(avg(nb_seismes), 0)) AS INTEGER) AS central FROM l4),
    fc2 AS (SELECT next_week_start, central, greatest(central - 50, 0) AS low, central + 50 AS high FROM fc)"""


@register("W13_P21_P24_P32_week_on_week", f"""{LAST8},
    c AS (SELECT date, nb_seismes, lag(nb_seismes) OVER (ORDER BY date) AS prev,
                 row_number() OVER (ORDER BY date DESC) AS rk FROM l8)
    SELECT {dstr('date')} AS date, nb_seismes, CAST(nb_seismes - prev AS BIGINT) AS diff,
        CASE WHEN prev IS NOT NULL THEN {r6('coalesce((nb_seismes - prev) * 100.0 / nullif(prev, 0), 0.0)')} END AS pct,
        CASE WHEN prev IS NULL THEN NULL WHEN nb_seismes - prev > 50 THEN 'forte_hausse'
             WHEN nb_seismes - prev > 10 THEN 'hausse' WHEN nb_seismes - prev < -50 THEN 'forte_baisse'
             WHEN nb_seismes - prev < -10 THEN 'baisse' ELSE 'stable' END AS trend,
        CASE WHEN prev IS NOT NULL THEN printf('%+d (%+.1f%%)', CAST(nb_seismes - prev AS INTEGER),
             coalesce((nb_seismes - prev) * 100.0 / nullif(prev, 0), 0.0)) END AS change_text,
        CAST(rk = 1 AS BIGINT) AS is_current
    FROM c""")
def q_wow(spark, sf_dir):
    """Week-on-week table over the last 8 weeks with trend bands and change text."""
    return finalize(week_on_week(weekly_series(quake_long(spark, sf_dir)), 8))


@register("A19_P23_anomaly", f"""{LAST8}
    SELECT {r6('avg(nb_seismes)')} AS mean_n, {r6('stddev_samp(nb_seismes)')} AS std_n,
           CAST(arg_max(nb_seismes, date) AS BIGINT) AS current,
           {r6('CASE WHEN stddev_samp(nb_seismes) > 0 THEN (arg_max(nb_seismes, date) - avg(nb_seismes)) / stddev_samp(nb_seismes) ELSE 0.0 END')} AS z_score,
           CASE WHEN abs(CASE WHEN stddev_samp(nb_seismes) > 0 THEN (arg_max(nb_seismes, date) - avg(nb_seismes)) / stddev_samp(nb_seismes) ELSE 0.0 END) > 2 THEN 'anomalie'
                WHEN abs(CASE WHEN stddev_samp(nb_seismes) > 0 THEN (arg_max(nb_seismes, date) - avg(nb_seismes)) / stddev_samp(nb_seismes) ELSE 0.0 END) > 1 THEN 'inhabituel'
                ELSE 'normal' END AS anomaly
    FROM l8""")
def q_anomaly(spark, sf_dir):
    """z-score of the newest week against the last 8 and its band."""
    return finalize(anomaly(weekly_series(quake_long(spark, sf_dir)), 8))


@register("J9_P22_compare_forecast", f"""{FILLED}, {FORECAST_SQL},
    cur AS (SELECT arg_max(nb_seismes, date) AS current, max(date) AS current_week FROM filled)
    SELECT {dstr('next_week_start')} AS next_week_start, {dstr('current_week')} AS current_week,
           CAST(current AS BIGINT) AS current, CAST(central AS BIGINT) AS central,
           CAST(central - current AS BIGINT) AS diff,
           {r6('coalesce((central - current) * 100.0 / nullif(current, 0), 0.0)')} AS diff_pct,
           CAST(high - low AS BIGINT) AS interval_width,
           CASE WHEN central > current * 1.2 THEN 'hausse' WHEN central < current * 0.8 THEN 'baisse'
                ELSE 'stable' END AS direction
    FROM fc2, cur""")
def q_compare(spark, sf_dir):
    """Forecast (4-week-mean baseline, +-50 interval) vs the newest week."""
    weekly = materialize(weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes"))
    return finalize(compare_forecast(weekly, rolling_mean_forecast(weekly)))


@register("P33_bar_lengths", f"""{LAST8}, {FORECAST_SQL},
    b AS (SELECT date, CAST(nb_seismes AS BIGINT) AS v, 0 AS is_forecast FROM l8
          UNION ALL SELECT next_week_start, CAST(central AS BIGINT), 1 FROM fc2)
    SELECT {dstr('date')} AS date, v, CAST(is_forecast AS BIGINT) AS is_forecast,
           CAST(trunc((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 1) * 40) AS BIGINT) AS bar
    FROM b""")
def q_bars(spark, sf_dir):
    """Bar lengths over the last 8 weeks plus the forecast week."""
    weekly = materialize(weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes"))
    fc = rolling_mean_forecast(weekly).select(F.col("next_week_start").alias("date"), "central")
    return finalize(bar_lengths(weekly, fc, 8))
