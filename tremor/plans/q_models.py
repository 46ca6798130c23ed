"""Registered queries: forecasting models (M3, M6-M13) on the weekly table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions.scalars import nonneg_int
from tremor.operators import joins as J
from tremor.operators import ml
from tremor.operators import rollup as R
from tremor.operators.common import attach_row
from tremor.operators import stats as ST
from tremor.operators import windows as W
from tremor.operators.boosting import apply_quantile_interval, pinball_loss, train_interval
from tremor.operators.together import side_by_side
from tremor.plans.catalog import register
from tremor.plans.q_windows import _feature_sql, baseline_predictions
from tremor.plans.report import dstr, finalize, r6
from tremor.plans.sqlparts import WITH_LONG, filled_weekly_sql, spine_sql, wk
from tremor.plans.weekly import MODEL_FEATURES, next_features, weekly_features, weekly_series
from tremor.sources.documents import ordered_records
from tremor.session import materialize
from tremor.sources.views import quake_long

FILLED = f"{WITH_LONG}, {filled_weekly_sql()}"
# The features of the zone model.
ZONE_FEATURES = ["zone", "lag_1", "lag_2", "lag_3", "lag_4", "rolling_mean_4", "rolling_mean_8"]


@register("M3_minmax", f"""{FILLED}
    SELECT {dstr('date')} AS date,
      {r6('coalesce((nb_seismes - min(nb_seismes) OVER ()) / nullif(max(nb_seismes) OVER () - min(nb_seismes) OVER (), 0), 0.0)')} AS nb_seismes,
      {r6('coalesce((mag_max - min(mag_max) OVER ()) / nullif(max(mag_max) OVER () - min(mag_max) OVER (), 0), 0.0)')} AS mag_max,
      {r6('coalesce((depth_mean - min(depth_mean) OVER ()) / nullif(max(depth_mean) OVER () - min(depth_mean) OVER (), 0), 0.0)')} AS depth_mean
    FROM filled""")
def q_minmax(spark, sf_dir):
    weekly = materialize(weekly_series(quake_long(spark, sf_dir)).select("date", "nb_seismes", "mag_max", "depth_mean"))
    return finalize(ml.minmax(weekly, ["nb_seismes", "mag_max", "depth_mean"]))


@register("M9_conformal_interval", f"""{_feature_sql(log_energy=False)},
    r AS (SELECT date, CAST(nb_seismes AS DOUBLE) AS y, rolling_mean_4 AS yhat,
                 row_number() OVER (ORDER BY date DESC) <= 52 AS is_test FROM feat),
    q AS (SELECT quantile_cont(y - yhat, 0.10) AS q_lo, quantile_cont(y - yhat, 0.90) AS q_hi
          FROM r WHERE NOT is_test AND yhat IS NOT NULL)
    SELECT {dstr('date')} AS date, {r6('y')} AS y, {r6('yhat')} AS yhat,
           {r6('least(greatest(yhat + q_lo, 0.0), yhat)')} AS lo, {r6('greatest(yhat + q_hi, yhat)')} AS hi
    FROM r, q WHERE is_test""")
def q_conformal(spark, sf_dir):
    """Split-conformal 10-90 % interval around the 4-week-mean forecast:
    residual quantiles from the weeks before the hold-out, applied to it."""
    feats = materialize(W.holdout_last(weekly_features(quake_long(spark, sf_dir)), 52))
    pred = feats.select("date", "is_test", F.col("nb_seismes").cast("double").alias("y"),
                        F.col("rolling_mean_4").alias("yhat"))
    bounds = ml.conformal_bounds(pred.where(~F.col("is_test")))
    return finalize(ml.apply_interval(pred.where("is_test"), bounds).drop("is_test"))


def _train_test(spark, sf_dir):
    # a row a week, written once: both parts read it
    feats = materialize(weekly_features(quake_long(spark, sf_dir)).dropna(subset=MODEL_FEATURES + ["nb_seismes"]))
    split = W.holdout_last(feats, 52)
    train = W.holdout_last(split.where(~F.col("is_test")).drop("is_test"), 40).withColumnRenamed("is_test", "is_val")
    return materialize(train), materialize(split.where("is_test"))


@register("M6_M7_M9_M12_model_comparison")
def q_models(spark, sf_dir):
    """Random forest and boosted trees vs the SQL baselines on the 52-week
    hold-out (leaderboard by MAE); interval coverage of the conformal band."""
    train, test = _train_test(spark, sf_dir)
    fit_rows = train.where(~F.col("is_val"))
    rounds, step, depth = ml.GBT_CONFIGS["gbt"]
    rf, gbt = side_by_side(spark, [
        lambda: ml.train_rf(fit_rows, MODEL_FEATURES, num_trees=500, max_depth=10, min_leaf=5),
        lambda: ml.train_gbt(train, MODEL_FEATURES, max_iter=rounds, step=step, max_depth=depth, validation_col="is_val")])
    rows = []
    for name, model in (("random_forest", rf), ("gbt", gbt)):
        val = ml.predict(model, train.where("is_val"), MODEL_FEATURES).select(
            F.col("nb_seismes").cast("double").alias("y"), "yhat")
        scored = ml.predict(model, test, MODEL_FEATURES).select(
            F.lit(name).alias("model"), "date", F.col("nb_seismes").cast("double").alias("y"), "yhat")
        cov = ST.coverage(ml.apply_interval(scored, ml.conformal_bounds(val)), "y", "lo", "hi")
        met = ST.regression_metrics(scored, "y", "yhat", by=["model"])
        rows.append(attach_row(met, cov))
    base = ST.regression_metrics(baseline_predictions(spark, sf_dir), "y", "yhat", by=["model"]).withColumn(
        "coverage_pct", F.lit(None).cast("double"))
    out = rows[0].unionByName(rows[1]).unionByName(base)
    return finalize(out.orderBy("mae", "model"))


@register("M9_quantile_interval")
def q_quantile_interval(spark, sf_dir):
    """10-90 % interval of boosted quantile models on the 52-week hold-out,
    beside the conformal band, around one central model; both coverages and
    the mean pinball loss of both ends, with the loss of constant quantiles."""
    train, test = _train_test(spark, sf_dir)
    rounds, step, depth = ml.GBT_CONFIGS["gbt"]
    both = train.drop("is_val")
    gbt, (low, high) = side_by_side(spark, [
        lambda: ml.train_gbt(train, MODEL_FEATURES, max_iter=rounds, step=step, max_depth=depth, validation_col="is_val"),
        lambda: train_interval(both, MODEL_FEATURES)])
    val = ml.predict(gbt, train.where("is_val"), MODEL_FEATURES).select(F.col("nb_seismes").cast("double").alias("y"), "yhat")
    central = ml.predict(gbt, test, MODEL_FEATURES).withColumn("y", F.col("nb_seismes").cast("double"))
    scored = ml.apply_interval(apply_quantile_interval(central, low, high), ml.conformal_bounds(val)).select("date", "y", "yhat", "quantile_lo", "quantile_hi", "lo", "hi")
    scored = materialize(scored)
    y = F.col("y")
    told = scored.agg((F.avg(y.between(F.col("quantile_lo"), F.col("quantile_hi")).cast("int")) * 100).alias("quantile_coverage_pct"),
                      (F.avg(y.between(F.col("lo"), F.col("hi")).cast("int")) * 100).alias("conformal_coverage_pct"),
                      F.avg(pinball_loss(y, F.col("quantile_lo"), 0.1)).alias("low_loss"), F.avg(pinball_loss(y, F.col("quantile_hi"), 0.9)).alias("high_loss"),
                      F.avg(pinball_loss(y, F.lit(low.start), 0.1)).alias("constant_low_loss"),
                      F.avg(pinball_loss(y, F.lit(high.start), 0.9)).alias("constant_high_loss"))
    return finalize(attach_row(scored, told).orderBy("date"))


@register("M11_walk_forward_gbt")
def q_walk_forward(spark, sf_dir):
    """Walk-forward validation (5 expanding folds, side by side) of boosted
    trees, 500 rounds on all training weeks of a fold: MAE per fold summarised
    as mean ± population sd."""
    feats = weekly_features(quake_long(spark, sf_dir)).dropna(subset=MODEL_FEATURES + ["nb_seismes"])
    rounds, step, depth = ml.GBT_CONFIGS["gbt_walk_forward"]

    def fit(train):
        return ml.train_gbt(train, MODEL_FEATURES, max_iter=rounds, step=step, max_depth=depth, column_share="all")

    per_fold = ml.walk_forward(feats, MODEL_FEATURES, fit)
    return finalize(ST.cv_summary(per_fold, "mae"))


@register("M13_forecast_next")
def q_forecast(spark, sf_dir):
    """Next-week forecast document: boosted-tree central value on the
    next-week feature row, conformal low/high, current week and the last
    12 weeks of history (bounded array)."""
    feats = materialize(weekly_features(quake_long(spark, sf_dir)))
    train = W.holdout_last(feats.dropna(subset=MODEL_FEATURES + ["nb_seismes"]), 40).withColumnRenamed("is_test", "is_val")
    gbt = ml.train_gbt(train, MODEL_FEATURES, validation_col="is_val")
    val = ml.predict(gbt, train.where("is_val"), MODEL_FEATURES).select(
        F.col("nb_seismes").cast("double").alias("y"), "yhat")
    nxt = ml.predict(gbt, next_features(feats).fillna(0.0), MODEL_FEATURES)
    band = ml.apply_interval(nxt, ml.conformal_bounds(val))
    pred = band.select(F.col("next_date"), nonneg_int("yhat").alias("central"),
                       nonneg_int("lo").alias("low"), nonneg_int("hi").alias("high"))
    cur = feats.orderBy(F.desc("date")).limit(1).select(
        F.struct(F.date_format("date", "yyyy-MM-dd").alias("start"), F.col("nb_seismes").cast("int").alias("nb_seismes"),
                 F.round("mag_max", 2).alias("mag_max"), F.col("nb_zones").cast("int").alias("nb_zones")).alias("current_week"))
    hist = W.tail(feats.select("date", "nb_seismes"), 12).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("nb_seismes").cast("int").alias("nb_seismes"))
    hist_doc = hist.agg(ordered_records(hist, ["date", "nb_seismes"], [("date", False)]).alias("history_12w"))
    doc = (attach_row(attach_row(pred, cur), hist_doc)
           .select(F.date_format("next_date", "yyyy-MM-dd").alias("next_week_start"), F.lit("gbt_global").alias("model_used"),
                   F.struct("central", "low", "high").alias("prediction"), "current_week", "history_12w"))
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("document"), "prediction.central",
                      "prediction.low", "prediction.high")


@register("M8_zone_forecast")
def q_zone_forecast(spark, sf_dir):
    """Per-zone boosted trees with the zone as a feature on the dense zone
    grid, 200 rounds on all training weeks; split by week (last 20 % of weeks test).  The prediction row of each
    zone is the appended next week, run through the same feature code."""
    from tremor.plans.q_windows import zone_feature_columns
    grid = materialize(J.dense_grid(R.zone_weekly(quake_long(spark, sf_dir))))
    after = grid.agg(F.date_add(F.max("date"), 7).alias("date"))
    future = attach_row(grid.select("zone").distinct(), after).select("date", "zone", F.lit(None).cast("bigint").alias("nb_seismes"))
    rows = materialize(zone_feature_columns(grid.unionByName(future)))
    known = rows.dropna()
    data = known.join(W.holdout_frac(known.select("date").distinct(), 0.8), "date")
    rounds, step, depth = ml.GBT_CONFIGS["gbt_zone"]
    train = data.where(~F.col("is_test")).drop("is_test")
    gbt = ml.train_gbt(train, ZONE_FEATURES, max_iter=rounds, step=step, max_depth=depth, partitions=None, column_share="all")
    test = ml.predict(gbt, data.where("is_test"), ZONE_FEATURES)
    mae = test.agg(F.avg(F.abs(F.col("nb_seismes") - F.col("yhat"))).alias("test_mae"))
    nxt = attach_row(rows, after.withColumnRenamed("date", "next_week")).where("date = next_week")
    pred = ml.predict(gbt, nxt, ZONE_FEATURES).select("zone", "next_week", nonneg_int("yhat").alias("pred_seismes"))
    return finalize(attach_row(pred, mae).orderBy(F.desc("pred_seismes"), "zone"))


@register("L1_forecast_job")
def q_forecast_job(spark, sf_dir):
    """The forecast job end to end on the long catalogue, as of its last
    week: snapshot, history upsert, features, next-week row, 4-week-mean
    prediction with the fixed interval, document (JSON text)."""
    from tremor.plans.jobs import forecast_job
    doc = forecast_job(quake_long(spark, sf_dir), "2001-08-01 12:00:00")
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("document"), "prediction.central",
                      "prediction.low", "prediction.high")


@register("M13_forecast_next_consistent")
def q_forecast_consistent(spark, sf_dir):
    """Next-week forecast without train/serve skew: same-week
    measures enter as last week's values, and the prediction row is the
    appended future week run through the same feature code; boosted trees
    with early stopping on a validation slice, conformal 10-90 % band."""
    from tremor.plans.weekly import CONSISTENT_FEATURES, consistent_training_rows
    rows = materialize(consistent_training_rows(weekly_series(quake_long(spark, sf_dir))))
    future = rows.orderBy(F.desc("date")).limit(1)
    train = W.holdout_last(rows.where(F.col("nb_seismes").isNotNull()).dropna(subset=CONSISTENT_FEATURES), 40)
    train = train.withColumnRenamed("is_test", "is_val")
    gbt = ml.train_gbt(train, CONSISTENT_FEATURES, validation_col="is_val")
    val = ml.predict(gbt, train.where("is_val"), CONSISTENT_FEATURES).select(
        F.col("nb_seismes").cast("double").alias("y"), "yhat")
    band = ml.apply_interval(ml.predict(gbt, future, CONSISTENT_FEATURES), ml.conformal_bounds(val))
    return finalize(band.select(F.col("date").alias("next_week_start"), nonneg_int("yhat").alias("central"),
                                nonneg_int("lo").alias("low"), nonneg_int("hi").alias("high")))


_L1_AS_OF = "2001-08-01 12:00:00"


@register("L1_forecast_fields", f"""{WITH_LONG},
    a AS (SELECT date_trunc('week', TIMESTAMP '{_L1_AS_OF}') AS ws),
    eq AS (SELECT * FROM quake_long, a),
    w AS (SELECT {wk('time_utc', 'iso_end')} AS date, count(id) AS nb, max(mag) AS mag_max, count(DISTINCT place) AS nz
          FROM eq WHERE time_utc < ws GROUP BY 1),
    s AS (SELECT CAST(any_value(a.ws) AS DATE) + 6 AS date, count(id) AS nb, coalesce(max(mag), 0.0) AS mag_max, count(DISTINCT place) AS nz
          FROM a LEFT JOIN quake_long ON time_utc >= a.ws AND time_utc < a.ws + INTERVAL 7 DAY),
    u AS (SELECT * FROM w UNION ALL SELECT * FROM s),
    sp AS ({spine_sql('u')}),
    f AS (SELECT sp.date, coalesce(nb, 0) AS nb, mag_max, coalesce(nz, 0) AS nz FROM sp LEFT JOIN u ON sp.date = u.date),
    r AS (SELECT *, avg(nb) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS yhat, row_number() OVER (ORDER BY date DESC) AS back FROM f),
    h AS (SELECT string_agg(strftime(date, '%Y-%m-%d') || ':' || nb, ',' ORDER BY date) AS history FROM r WHERE back <= 12)
    SELECT strftime(date + 7, '%Y-%m-%d') AS next_week_start, 'rolling_mean_4' AS model_used, CAST(trunc(yhat) AS BIGINT) AS central,
           CAST(greatest(trunc(yhat) - 50, 0) AS BIGINT) AS low, CAST(trunc(yhat) + 50 AS BIGINT) AS high, strftime(date, '%Y-%m-%d') AS current_start,
           CAST(nb AS BIGINT) AS current_events, {r6('round(mag_max, 2)')} AS current_mag_max, CAST(nz AS BIGINT) AS current_zones, history
    FROM r, h WHERE back = 1""")
def q_forecast_fields(spark, sf_dir):
    """The fields of the forecast job's document (L1): next week, prediction with
    its fixed interval, current week and the last 12 weeks."""
    from tremor.plans.jobs import forecast_job
    doc = forecast_job(quake_long(spark, sf_dir), _L1_AS_OF)
    weeks = F.transform("history_12w", lambda w: F.concat_ws(":", w["date"], w["nb_seismes"].cast("string")))
    return finalize(doc.select(
        "next_week_start", "model_used", "prediction.central", "prediction.low", "prediction.high", F.col("current_week.start").alias("current_start"),
        F.col("current_week.nb_seismes").alias("current_events"), F.col("current_week.mag_max").alias("current_mag_max"),
        F.col("current_week.nb_zones").alias("current_zones"), F.array_join(weeks, ",").alias("history")))
