"""Registered queries: rollups and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators import joins as J
from tremor.operators import rollup as R
from tremor.operators import windows as W
from tremor.operators import stats as ST
from tremor.plans.catalog import register
from tremor.plans.q_weekly import _feature_sql
from tremor.plans.report import dstr, finalize, r6
from tremor.plans.sqlparts import WITH_LONG, WITH_QUAKE, filled_weekly_sql, wk
from tremor.plans.weekly import (COUNT_LAGS, ENERGY_LAGS, ENERGY_ROLL, ROLL_MAX, ROLL_MEAN, ZONE_LAGS,
                                 weekly_features, weekly_series)
from tremor.session import materialize
from tremor.sources.views import quake, quake_long

WEEKLY_COLS = ["nb_seismes", "mag_max", "mag_mean", "mag_median", "depth_mean", "tsunami_sum",
               "nb_zones", "energy_sum"]

# The 33 candidate features ranked against the target (notebook §02).
CANDIDATE_FEATURES = (
    [f"lag_{k}" for k in COUNT_LAGS] + [f"energy_lag_{k}" for k in ENERGY_LAGS]
    + [f"zones_lag_{k}" for k in ZONE_LAGS] + [f"rolling_mean_{n}" for n in ROLL_MEAN]
    + ["rolling_std_4", "rolling_std_8"] + [f"rolling_max_{n}" for n in ROLL_MAX]
    + [f"energy_rolling_{n}" for n in ENERGY_ROLL]
    + ["mag_max", "mag_spread", "depth_mean", "energy_per_seisme", "log_energy", "nb_zones",
       "week_sin", "week_cos", "month_sin", "month_cos", "quarter"])

FILLED = f"{WITH_LONG}, {filled_weekly_sql()}"


@register("A4_daily_counts", f"""{WITH_QUAKE}
    SELECT strftime(CAST(time_utc AS DATE), '%Y-%m-%d') AS date, count(*) AS nb_seismes
    FROM quake WHERE time_utc IS NOT NULL GROUP BY 1""")
def q_daily(spark, sf_dir):
    return finalize(R.daily_counts(quake(spark, sf_dir)))


@register("A5_A6_zone_weekly", f"""{WITH_LONG}
    SELECT {dstr(wk())} AS date, zone, count(*) AS nb_seismes, {r6('avg(latitude)')} AS latitude,
           {r6('avg(longitude)')} AS longitude
    FROM quake_long WHERE time_utc IS NOT NULL AND zone IS NOT NULL GROUP BY 1, 2""")
def q_zone_weekly(spark, sf_dir):
    """Zone x week counts with mean coordinates."""
    return finalize(R.zone_weekly(quake_long(spark, sf_dir), with_centroid=True))


@register("A6_zone_centroids", f"""{WITH_LONG}
    SELECT zone, {r6('avg(latitude)')} AS latitude, {r6('avg(longitude)')} AS longitude,
           {r6('degrees(atan2(avg(sin(radians(longitude))), avg(cos(radians(longitude)))))')} AS longitude_circular
    FROM quake_long GROUP BY zone""")
def q_centroids(spark, sf_dir):
    """Arithmetic and circular (date-line safe) mean coordinates per zone."""
    return finalize(R.zone_centroids(quake_long(spark, sf_dir), both=True))


@register("A7_value_counts", f"""{WITH_QUAKE} SELECT net, count(*) AS n FROM quake GROUP BY net""")
def q_value_counts(spark, sf_dir):
    return finalize(R.value_counts(quake(spark, sf_dir), "net"))


@register("A9_P17_iqr_outliers", f"""{FILLED},
    b AS (SELECT quantile_cont(nb_seismes, 0.25) AS q1, quantile_cont(nb_seismes, 0.75) AS q3 FROM filled)
    SELECT {dstr('date')} AS date, nb_seismes, {r6('q1')} AS q1, {r6('q3')} AS q3,
           {r6('q1 - 3 * (q3 - q1)')} AS lower, {r6('q3 + 3 * (q3 - q1)')} AS upper,
           CAST(nb_seismes < q1 - 3 * (q3 - q1) OR nb_seismes > q3 + 3 * (q3 - q1) AS BIGINT) AS is_outlier,
           {r6('least(greatest(nb_seismes, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1))')} AS nb_seismes_clean
    FROM filled, b""")
def q_iqr(spark, sf_dir):
    """3xIQR fences on the weekly count, outlier flag and winsorised copy."""
    weekly = materialize(weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes"))
    return finalize(ST.iqr_outliers(weekly, "nb_seismes", k=3.0))


@register("A10_tier_bounds", f"""{WITH_LONG},
    z AS (SELECT {wk()} AS date, zone, count(*) AS n FROM quake_long GROUP BY 1, 2)
    SELECT {r6('quantile_cont(n, 0.33)')} AS p33, {r6('quantile_cont(n, 0.66)')} AS p66 FROM z""")
def q_tiers(spark, sf_dir):
    """33rd/66th percentiles of zone-week counts (linear interpolation)."""
    zw = R.zone_weekly(quake_long(spark, sf_dir))
    return finalize(ST.tier_bounds(zw, "nb_seismes"))


def _corr_matrix_sql() -> str:
    parts, names = [], []
    for a in WEEKLY_COLS:
        for b in WEEKLY_COLS:
            expr = "1.0" if a == b else f"corr({a}, {b})"
            parts.append(f"{expr} AS {a}__{b}")
            names.append(f"{a}__{b}")
    return f"""{FILLED}, m AS (SELECT {', '.join(parts)} FROM filled),
    u AS (SELECT * FROM m UNPIVOT (corr FOR pair IN ({', '.join(names)})))
    SELECT split_part(pair, '__', 1) AS feature_a, split_part(pair, '__', 2) AS feature_b,
           {r6('corr')} AS corr FROM u"""


@register("A11_corr_matrix", _corr_matrix_sql())
def q_corr_matrix(spark, sf_dir):
    """Pearson matrix of the 8 weekly measures (long form)."""
    return finalize(ST.corr_matrix(weekly_series(quake_long(spark, sf_dir)), WEEKLY_COLS))


def _corr_target_sql() -> str:
    feats = CANDIDATE_FEATURES
    allcols = feats + ["nb_seismes", "date", "tsunami_sum", "mag_mean", "mag_median", "energy_sum",
                       "rolling_std_12", "week_of_year", "month", "year", "tsunami_ratio",
                       "delta_seismes"]
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in sorted(set(allcols)))
    return f"""{_feature_sql(log_energy=False)},
    m AS (SELECT {', '.join(f'corr({f}, nb_seismes) AS {f}' for f in feats)} FROM feat WHERE {notnull}),
    u AS (SELECT * FROM m UNPIVOT (corr FOR feature IN ({', '.join(feats)})))
    SELECT feature, {r6('corr')} AS corr FROM u"""


@register("A12_corr_target", _corr_target_sql())
def q_corr_target(spark, sf_dir):
    """Feature-to-target correlation on complete rows (dropna), descending."""
    feats = weekly_features(quake_long(spark, sf_dir)).dropna()
    return finalize(ST.corr_target(feats, CANDIDATE_FEATURES, "nb_seismes"))


_QUAKE_COLS = ["id", "time_utc", "mag", "depth_km", "latitude", "longitude", "gap", "rms", "nst",
               "dmin", "sig", "tsunami", "type", "net", "place"]


@register("A13_missing_report", f"""{WITH_QUAKE},
    m AS (SELECT count(*) AS __rows, {', '.join(f'count_if({c} IS NULL) AS {c}' for c in _QUAKE_COLS)} FROM quake),
    u AS (SELECT * FROM m UNPIVOT (missing_count FOR column_name IN ({', '.join(_QUAKE_COLS)})))
    SELECT column_name, missing_count, {r6('round(missing_count * 100.0 / __rows, 2)')} AS missing_pct
    FROM u WHERE missing_count > 0""")
def q_missing(spark, sf_dir):
    return finalize(ST.missing_report(quake(spark, sf_dir)))


@register("A14_summary", f"""{FILLED}
    SELECT count(*) AS rows, {dstr('min(date)')} AS date_min, {dstr('max(date)')} AS date_max,
           CAST(min(nb_seismes) AS BIGINT) AS value_min, CAST(max(nb_seismes) AS BIGINT) AS value_max,
           {r6('avg(nb_seismes)')} AS value_mean FROM filled""")
def q_summary(spark, sf_dir):
    return finalize(ST.summary(weekly_series(quake_long(spark, sf_dir)), "date", "nb_seismes"))


@register("A17_distinct_places", f"""{WITH_QUAKE}
    SELECT net, count(DISTINCT place) AS n_places FROM quake GROUP BY net""")
def q_distinct(spark, sf_dir):
    df = quake(spark, sf_dir)
    return finalize(df.groupBy("net").agg(F.countDistinct("place").alias("n_places")))


@register("A18_zero_periods", f"""{FILLED} SELECT count_if(nb_seismes = 0) AS zero_periods FROM filled""")
def q_zero(spark, sf_dir):
    return finalize(R.zero_periods(weekly_series(quake_long(spark, sf_dir))))


def _acf_sql(max_lag: int = 60) -> str:
    lags = ", ".join(f"lag(d, {k}) OVER (ORDER BY date) AS l{k}" for k in range(max_lag + 1))
    parts = " UNION ALL ".join(
        f"SELECT {k} AS lag, {r6(f'sum(d * l{k}) / sum(d * d)')} AS acf FROM lagged" for k in range(max_lag + 1))
    return f"""{FILLED}, c AS (SELECT date, nb_seismes - avg(nb_seismes) OVER () AS d FROM filled),
    lagged AS (SELECT d, {lags} FROM c) {parts}"""


@register("A20_acf", _acf_sql())
def q_acf(spark, sf_dir):
    """Autocorrelation of the weekly count, lags 0..60."""
    return finalize(ST.acf(weekly_series(quake_long(spark, sf_dir)), "nb_seismes", 60))


@register("A25_histogram", f"""{FILLED}, b AS (SELECT min(nb_seismes) AS lo, max(nb_seismes) AS hi FROM filled)
    SELECT CAST(CASE WHEN lo = hi THEN 1 ELSE least(floor(40 * (nb_seismes - lo) / (hi - lo)) + 1, 40) END AS BIGINT) AS bin,
           count(*) AS n, CAST(min(lo) AS BIGINT) AS lo, CAST(min(hi) AS BIGINT) AS hi
    FROM filled, b WHERE nb_seismes IS NOT NULL GROUP BY 1""")
def q_hist(spark, sf_dir):
    """40-bin equal-width histogram of the weekly count."""
    weekly = materialize(weekly_series(quake_long(spark, sf_dir)).select("nb_seismes"))
    return finalize(ST.histogram(weekly, "nb_seismes", 40))


@register("A25_five_numbers", f"""{FILLED}
    SELECT CAST(min(nb_seismes) AS BIGINT) AS min, {r6('quantile_cont(nb_seismes, 0.25)')} AS q1,
           {r6('quantile_cont(nb_seismes, 0.5)')} AS median, {r6('quantile_cont(nb_seismes, 0.75)')} AS q3,
           CAST(max(nb_seismes) AS BIGINT) AS max FROM filled""")
def q_five(spark, sf_dir):
    return finalize(ST.five_numbers(weekly_series(quake_long(spark, sf_dir)), "nb_seismes"))


@register("A3_weekly_energy", f"""{WITH_LONG}
    SELECT {dstr(wk())} AS date, {r6('ln(1 + sum(pow(10.0, 1.5 * mag)))')} AS log1p_energy_sum
    FROM quake_long WHERE time_utc IS NOT NULL GROUP BY 1""")
def q_weekly_energy(spark, sf_dir):
    """Weekly sum of released-energy proxies (log1p in the report)."""
    e = R.weekly_energy(quake_long(spark, sf_dir))
    return finalize(e.select("date", F.log1p("energy_sum").alias("log1p_energy_sum")))


@register("J1_join_weekly_energy", f"""{WITH_LONG},
    c AS (SELECT {wk()} AS date, count(id) AS nb_seismes FROM quake_long WHERE time_utc IS NOT NULL GROUP BY 1),
    e AS (SELECT {wk()} AS date, sum(pow(10.0, 1.5 * mag)) AS energy_sum FROM quake_long WHERE time_utc IS NOT NULL GROUP BY 1)
    SELECT {dstr('c.date')} AS date, c.nb_seismes, {r6('ln(1 + coalesce(e.energy_sum, 0))')} AS log1p_energy_sum
    FROM c LEFT JOIN e ON c.date = e.date""")
def q_join_energy(spark, sf_dir):
    """The notebook's two-pass form: weekly counts left-joined with weekly
    energy on the week (the fused rollup A1 does both in one aggregate)."""
    src = quake_long(spark, sf_dir)
    counts = R.weekly_rollup(src, with_energy=False).select("date", "nb_seismes")
    joined = J.join_left(counts, R.weekly_energy(src), "date").fillna(0.0, subset=["energy_sum"])
    return finalize(joined.select("date", "nb_seismes", F.log1p("energy_sum").alias("log1p_energy_sum")))


@register("J2_zone_counts_centres", f"""{WITH_LONG},
    z AS (SELECT {wk()} AS date, zone, count(*) AS nb_seismes FROM quake_long GROUP BY 1, 2),
    c AS (SELECT zone, avg(latitude) AS latitude, avg(longitude) AS longitude FROM quake_long GROUP BY zone)
    SELECT {dstr('z.date')} AS date, CAST(z.zone AS BIGINT) AS zone, z.nb_seismes, {r6('c.latitude')} AS latitude,
           {r6('c.longitude')} AS longitude
    FROM z JOIN c ON z.zone = c.zone""")
def q_zone_counts_centres(spark, sf_dir):
    """Weekly counts per zone inner-joined with the zone centres."""
    src = materialize(quake_long(spark, sf_dir).select("time_utc", "zone", "latitude", "longitude"))      # both sides read it
    return finalize(J.join_inner(R.zone_weekly(src), R.zone_centroids(src), "zone"))


@register("J2_J3_zone_map", f"""{WITH_LONG},
    z AS (SELECT {wk()} AS date, zone, count(*) AS nb_seismes FROM quake_long GROUP BY 1, 2),
    p AS (SELECT zone, nb_seismes FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY date DESC) AS rn FROM z) WHERE rn = 1),
    c AS (SELECT zone, avg(latitude) AS latitude, avg(longitude) AS longitude FROM quake_long GROUP BY zone)
    SELECT CAST(p.zone AS BIGINT) AS zone, CAST(p.nb_seismes AS BIGINT) AS pred_seismes,
           {r6('c.latitude')} AS latitude, {r6('c.longitude')} AS longitude
    FROM p LEFT JOIN c ON p.zone = c.zone""")
def q_zone_map(spark, sf_dir):
    """Persistence prediction per zone joined with the zone centres (map table)."""
    src = materialize(quake_long(spark, sf_dir).select("time_utc", "zone", "latitude", "longitude"))
    pred = W.persist_zone(R.zone_weekly(src)).select("zone", F.col("pred_seismes").cast("bigint").alias("pred_seismes"))
    return finalize(J.zone_map(pred, R.zone_centroids(src)))


@register("A12_corr_target_top5", _corr_target_sql() + " ORDER BY corr DESC, feature LIMIT 5")
def q_corr_target_top5(spark, sf_dir):
    """The five features most correlated with the weekly count (the limit is
    the report)."""
    feats = weekly_features(quake_long(spark, sf_dir)).dropna()
    return finalize(ST.corr_target(feats, CANDIDATE_FEATURES, "nb_seismes", top=5))
