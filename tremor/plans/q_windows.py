"""Registered queries: window operators, grids, splits and baselines
(J5, W8-W18, A22-A24, M10, M12, O3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators import joins as J
from tremor.operators import rollup as R
from tremor.operators import stats as ST
from tremor.operators import windows as W
from tremor.plans.catalog import register
from tremor.plans.q_weekly import _feature_sql
from tremor.plans.report import dstr, finalize, r6
from tremor.plans.sqlparts import WITH_LONG, filled_weekly_sql, roll_sql, wk
from tremor.plans.weekly import next_features, weekly_features, weekly_series
from tremor.session import materialize
from tremor.sources.views import quake_long

FILLED = f"{WITH_LONG}, {filled_weekly_sql()}"

ZONE_GRID_SQL = f"""{WITH_LONG},
    z AS (SELECT {wk()} AS date, zone, count(*) AS nb_seismes FROM quake_long
          WHERE time_utc IS NOT NULL AND zone IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT min(date) AS lo, max(date) AS hi FROM z),
    zs AS (SELECT DISTINCT zone FROM z),
    grid AS (SELECT zone, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS date FROM zs, b),
    g AS (SELECT grid.date, grid.zone, coalesce(z.nb_seismes, 0) AS nb_seismes
          FROM grid LEFT JOIN z ON grid.date = z.date AND grid.zone = z.zone)"""


def zone_features(spark, sf_dir):
    """J5 + W8 + W9: dense zone x week grid with per-zone lags and rolling stats."""
    return zone_feature_columns(J.dense_grid(R.zone_weekly(quake_long(spark, sf_dir))))


def zone_feature_columns(grid):
    """Lags and rolling statistics of a dense grid (date, zone, nb_seismes)."""
    out = W.add_lags(grid, "nb_seismes", [1, 2, 3, 4], by=["zone"], prefix="lag_")
    out = out.withColumns({f"lag_{k}": F.col(f"lag_{k}").cast("double") for k in [1, 2, 3, 4]})
    out = W.add_rolling(out, "nb_seismes", [4, 8], "mean", by=["zone"], prefix="rolling_mean_")
    return W.add_rolling(out, "nb_seismes", [4, 8], "std", by=["zone"], prefix="rolling_std_")


_zf_cols = [f"CAST(lag(nb_seismes, {k}) OVER (PARTITION BY zone ORDER BY date) AS DOUBLE) AS lag_{k}"
            for k in [1, 2, 3, 4]]
_zf_cols += [f"{roll_sql('nb_seismes', n, 'avg', part='zone')} AS rolling_mean_{n}" for n in [4, 8]]
_zf_cols += [f"{roll_sql('nb_seismes', n, 'stddev_samp', part='zone')} AS rolling_std_{n}" for n in [4, 8]]


@register("J5_W8_W9_zone_features", f"""{ZONE_GRID_SQL},
    f AS (SELECT date, zone, nb_seismes, {', '.join(_zf_cols)} FROM g)
    SELECT {dstr('date')} AS date, CAST(zone AS BIGINT) AS zone, nb_seismes,
           {', '.join(r6(c) + ' AS ' + c for c in ['lag_1', 'lag_2', 'lag_3', 'lag_4', 'rolling_mean_4', 'rolling_mean_8', 'rolling_std_4', 'rolling_std_8'])}
    FROM f""")
def q_zone_features(spark, sf_dir):
    return finalize(zone_features(spark, sf_dir))


@register("W10_latest_per_zone", f"""{WITH_LONG},
    z AS (SELECT {wk()} AS date, zone, count(*) AS nb_seismes FROM quake_long GROUP BY 1, 2)
    SELECT CAST(zone AS BIGINT) AS zone, {dstr('date')} AS date, nb_seismes FROM (
      SELECT *, row_number() OVER (PARTITION BY zone ORDER BY date DESC) AS rn FROM z) WHERE rn = 1""")
def q_latest(spark, sf_dir):
    """Newest week per zone (max_by aggregate, no per-zone sort)."""
    return finalize(W.latest_per(R.zone_weekly(quake_long(spark, sf_dir)), "zone", "date"))


@register("W11_tail_12", f"""{FILLED}
    SELECT {dstr('date')} AS date, nb_seismes FROM filled ORDER BY date DESC LIMIT 12""")
def q_tail(spark, sf_dir):
    """Last 12 weeks of the series (the forecast document's history)."""
    return finalize(W.tail(weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes"), 12))


_NEXT_SQL_COLS = {
    "nb_zones": "CAST(nb_zones AS DOUBLE)", "energy_per_seisme": "ln(1 + energy_per_seisme)",
    "log_energy": "log_energy", "energy_lag_1": "ln(1 + energy_sum)",
    "energy_rolling_4": "ln(1 + energy_rolling_4)", "mag_max": "mag_max", "mag_spread": "mag_spread",
    "depth_mean": "depth_mean", "lag_1": "CAST(nb_seismes AS DOUBLE)", "lag_2": "lag_1", "lag_3": "lag_2",
    "rolling_mean_4": "rolling_mean_4", "rolling_mean_8": "rolling_mean_8",
    "rolling_mean_26": "rolling_mean_26", "rolling_std_8": "rolling_std_8",
    "rolling_max_4": "rolling_max_4", "zones_lag_1": "CAST(nb_zones AS DOUBLE)",
    "zones_lag_2": "zones_lag_1", "week_sin": "sin(2 * pi() * weekofyear(date + 7) / 52.0)",
}
_LOGGED = {"energy_per_seisme", "energy_lag_1", "energy_rolling_4"}


@register("W12_next_features", f"""{_feature_sql(log_energy=False)}
    SELECT {dstr('date + 7')} AS next_date,
           {', '.join(r6(e) + ' AS ' + ('log1p_' + c if c in _LOGGED else c) for c, e in _NEXT_SQL_COLS.items())}
    FROM feat ORDER BY date DESC LIMIT 1""")
def q_next(spark, sf_dir):
    """Next-week model input row (19 features) from the newest week."""
    nf = next_features(weekly_features(quake_long(spark, sf_dir)))
    nf = nf.withColumns({c: F.log1p(c) for c in _LOGGED}).withColumnsRenamed({c: f"log1p_{c}" for c in _LOGGED})
    return finalize(nf)



@register("W15_holdout_last52", f"""{FILLED}
    SELECT {dstr('date')} AS date, nb_seismes,
           CAST(row_number() OVER (ORDER BY date DESC) <= 52 AS BIGINT) AS is_test FROM filled""")
def q_holdout(spark, sf_dir):
    weekly = weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes")
    return finalize(W.holdout_last(weekly, 52))


@register("W15_holdout_frac", f"""{FILLED}
    SELECT {dstr('date')} AS date, nb_seismes,
           CAST(row_number() OVER (ORDER BY date) > floor(count(*) OVER () * 0.8) AS BIGINT) AS is_test FROM filled""")
def q_holdout_frac(spark, sf_dir):
    """80 % positional split ordered by week."""
    weekly = weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes")
    return finalize(W.holdout_frac(weekly, 0.8))


_FOLDS_SQL = f"""{FILLED},
    n AS (SELECT date, nb_seismes, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS cnt FROM filled),
    f AS (SELECT n.*, fold, floor(cnt / 6) AS ts, cnt - (5 - fold + 1) * floor(cnt / 6) AS st
          FROM n, (SELECT unnest(generate_series(1, 5)) AS fold) folds)"""


@register("W16_ts_folds", f"""{_FOLDS_SQL}
    SELECT {dstr('date')} AS date, nb_seismes, CAST(fold AS BIGINT) AS fold,
           CASE WHEN rn < st THEN 'train' ELSE 'val' END AS role FROM f WHERE rn < st + ts""")
def q_folds(spark, sf_dir):
    """Expanding walk-forward folds (5)."""
    weekly = weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes")
    return finalize(W.ts_folds(weekly, 5))


def baseline_predictions(spark, sf_dir):
    """M12 inputs: (model, date, y, yhat) for SQL-computable baselines on the
    last 52 weeks — lag-1 (W17), lag-52 (seasonal) and 4-week mean."""
    feats = weekly_features(quake_long(spark, sf_dir))
    test = materialize(W.holdout_last(feats, 52).where("is_test"))
    y = F.col("nb_seismes").cast("double")
    models = {"naive_lag1": F.col("lag_1"), "seasonal_lag52": F.col("lag_52"),
              "rolling_mean_4": F.col("rolling_mean_4")}
    parts = [test.select(F.lit(m).alias("model"), "date", y.alias("y"), e.alias("yhat")) for m, e in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_BASE_SQL = f"""{_feature_sql(log_energy=False)},
    t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rk FROM feat) WHERE rk <= 52),
    p AS (SELECT 'naive_lag1' AS model, date, CAST(nb_seismes AS DOUBLE) AS y, lag_1 AS yhat FROM t
          UNION ALL SELECT 'seasonal_lag52', date, nb_seismes, lag_52 FROM t
          UNION ALL SELECT 'rolling_mean_4', date, nb_seismes, rolling_mean_4 FROM t)"""


@register("W17_A22_M12_O3_baselines", f"""{_BASE_SQL},
    e AS (SELECT * FROM p WHERE y IS NOT NULL AND yhat IS NOT NULL)
    SELECT model, count(*) AS n, {r6('avg(abs(y - yhat))')} AS mae, {r6('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse,
           {r6('avg(abs((y - yhat) / (y + 1))) * 100')} AS mape,
           {r6('1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(y))')} AS r2
    FROM e GROUP BY model ORDER BY mae""")
def q_baselines(spark, sf_dir):
    """Baseline leaderboard on the 52-week hold-out: MAE, RMSE, R², MAPE(+1), sorted by MAE."""
    metrics = ST.regression_metrics(baseline_predictions(spark, sf_dir), "y", "yhat", by=["model"])
    return finalize(metrics.orderBy("mae", "model"))


@register("A23_M10_coverage", f"""{_BASE_SQL}
    SELECT model, {r6("avg(CASE WHEN y BETWEEN greatest(yhat - 50, 0) AND yhat + 50 THEN 1.0 ELSE 0.0 END) * 100")} AS coverage_pct
    FROM p WHERE yhat IS NOT NULL GROUP BY model""")
def q_coverage(spark, sf_dir):
    """Coverage of the fixed +-50 fallback interval (M10) around each baseline."""
    p = baseline_predictions(spark, sf_dir).where(F.col("yhat").isNotNull())
    p = p.withColumn("lo", F.greatest(F.col("yhat") - 50, F.lit(0.0))).withColumn("hi", F.col("yhat") + 50)
    return finalize(ST.coverage(p, "y", "lo", "hi", by=["model"]))


@register("A24_walk_forward_naive", f"""{_FOLDS_SQL},
    v AS (SELECT f.fold, f.nb_seismes AS y, n.nb_seismes AS yhat FROM f JOIN n ON n.rn = f.rn - 1
          WHERE f.rn >= f.st AND f.rn < f.st + f.ts),
    m AS (SELECT fold, avg(abs(y - yhat)) AS mae FROM v GROUP BY fold)
    SELECT {r6('avg(mae)')} AS mae_mean, {r6('stddev_pop(mae)')} AS mae_std, count(*) AS folds FROM m""")
def q_cv(spark, sf_dir):
    """Walk-forward MAE of the lag-1 baseline per fold, mean ± population sd."""
    weekly = W.naive(weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes"))
    folds = W.ts_folds(weekly, 5).where(F.col("role") == "val")
    per_fold = folds.groupBy("fold").agg(F.avg(F.abs(F.col("nb_seismes") - F.col("yhat"))).alias("mae"))
    return finalize(ST.cv_summary(per_fold, "mae"))


@register("W18_persistence_zone", f"""{WITH_LONG},
    z AS (SELECT {wk()} AS date, zone, count(*) AS nb_seismes FROM quake_long GROUP BY 1, 2)
    SELECT CAST(zone AS BIGINT) AS zone, {dstr('date')} AS date, nb_seismes, CAST(nb_seismes AS BIGINT) AS pred_seismes FROM (
      SELECT *, row_number() OVER (PARTITION BY zone ORDER BY date DESC) AS rn FROM z) WHERE rn = 1""")
def q_persist(spark, sf_dir):
    return finalize(W.persist_zone(R.zone_weekly(quake_long(spark, sf_dir))))
