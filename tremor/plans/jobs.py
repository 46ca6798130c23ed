"""End-to-end jobs: forecast (L1), classification (L2), weekly monitoring
(L4) — the risk-zone job (L3) lives in ``plans/zones.py`` — and a
sequential runner that logs each job's status (S12): the batch counterpart
of the reference's periodic refresh, without its HTTP server or scheduler.

Each job is a composition of the library's operators; outputs go to Parquet
/ JSON under ``out_dir`` (a shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions.scalars import nonneg_int
from tremor.operators import ml
from tremor.operators.cleaning import only_kind
from tremor.operators.common import attach_row
from tremor.operators.joins import fill_weeks
from tremor.operators.rollup import week_snapshot, weekly_rollup
from tremor.operators.windows import tail
from tremor.plans.weekly import MODEL_FEATURES, add_weekly_features, next_features
from tremor.session import materialize
from tremor.sources.documents import ordered_records, write_document
from tremor.sources.history import freshness, log_run, upsert_period

MAX_NETWORKS = 500              # categories that are encoded as columns


def forecast_job(events: DataFrame, as_of: str, out_dir: str | None = None,
                 history: DataFrame | None = None, model=None, calibration: DataFrame | None = None,
                 ts: str = "time_utc") -> DataFrame:
    """L1: current-week snapshot (A2) -> upsert into the weekly history
    -> gap-free features (J4, W1-W7) -> next-week row (W12) -> prediction
    (M13; a fitted MLlib model, else the 4-week mean) -> interval (M9 from
    calibration residuals, else the fixed +-50 fallback, M10) -> document (S7).

    Returns the one-row document; with ``out_dir`` also writes the history
    (Parquet) and the document (JSON).
    """
    week_start = F.date_trunc("week", F.lit(as_of).cast("timestamp_ntz"))
    snapshot = week_snapshot(events, as_of, ts=ts)
    if history is None:
        before = only_kind(events).where(F.col(ts) < week_start)
        history = weekly_rollup(before, ts=ts, mode="iso_end")
    hist = materialize(upsert_period(history, snapshot, "date"))
    if out_dir:
        hist.write.mode("overwrite").parquet(f"{out_dir}/weekly_history")
    feats = materialize(add_weekly_features(fill_weeks(hist)))
    nxt = next_features(feats)
    if model is not None:
        scored = ml.predict(model, nxt.fillna(0.0), MODEL_FEATURES).select("next_date", "yhat")
    else:
        scored = nxt.select("next_date", F.coalesce(F.col("rolling_mean_4"), F.col("lag_1")).alias("yhat"))
    if calibration is not None:
        band = ml.apply_interval(scored, ml.conformal_bounds(calibration))
        pred = band.select("next_date", nonneg_int("yhat").alias("central"), nonneg_int("lo").alias("low"),
                           nonneg_int("hi").alias("high"))
    else:
        pred = ml.interval_fallback(scored.select("next_date", nonneg_int("yhat").alias("central")))
    cur = feats.orderBy(F.desc("date")).limit(1).select(F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("start"), F.col("nb_seismes").cast("int").alias("nb_seismes"),
        F.round("mag_max", 2).alias("mag_max"), F.col("nb_zones").cast("int").alias("nb_zones")).alias("current_week"))
    last12 = tail(feats.select("date", "nb_seismes"), 12).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("nb_seismes").cast("int").alias("nb_seismes"))
    hist12 = last12.agg(ordered_records(last12, ["date", "nb_seismes"], [("date", False)]).alias("history_12w"))
    doc = attach_row(attach_row(pred, cur), hist12).select(
        F.lit(as_of).alias("generated_at"), F.date_format("next_date", "yyyy-MM-dd").alias("next_week_start"),
        F.lit("gbt" if model is not None else "rolling_mean_4").alias("model_used"),
        F.struct(F.col("central").cast("int").alias("central"), F.col("low").cast("int").alias("low"),
                 F.col("high").cast("int").alias("high")).alias("prediction"),
        "current_week", "history_12w")
    if out_dir:
        write_document(doc, f"{out_dir}/forecast")
    return doc


def classification_job(events: DataFrame, as_of: str, out_dir: str | None = None, model_path: str | None = None,
                       lookback: str = "24 HOURS", ts: str = "time_utc", train: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """L2: events of the look-back window -> features imputed within that batch
    -> classifier -> scored records + one-row header (A8).

    The model and the network vocabulary it was fitted with live under
    ``model_path`` (any file system Spark reads).  When nothing is there, both
    are made from ``train`` (default: all events) and, with a path, saved.
    Records are written as JSON lines sorted by time (distributed), the
    header as one JSON row — never one row holding every record.
    """
    from pyspark.ml.classification import RandomForestClassificationModel

    from tremor.operators.cleaning import lookback as look_back
    from tremor.operators.rollup import class_summary
    from tremor.plans.classification import prepare, score, train_classifier
    from tremor.sources.documents import write_records
    from tremor.sources.files import load_model, path_exists, save_model

    spark = events.sparkSession
    if model_path and path_exists(spark, f"{model_path}/model"):
        model = load_model(RandomForestClassificationModel, f"{model_path}/model")
        vocab = [r.net for r in spark.read.parquet(f"{model_path}/vocabulary").orderBy("net").collect()]
    else:
        source = train if train is not None else events
        nets = materialize(source.where(F.col("net").isNotNull()).select("net").distinct())
        vocab = [r.net for r in nets.orderBy("net").limit(MAX_NETWORKS + 1).collect()]
        if len(vocab) > MAX_NETWORKS:
            raise ValueError(f"more than {MAX_NETWORKS} networks: give each its group before encoding")
        rows, names = prepare(source, vocab)
        model = train_classifier(rows, names)
        if model_path:
            save_model(model, f"{model_path}/model")
            nets.coalesce(1).write.mode("overwrite").parquet(f"{model_path}/vocabulary")
    rows, names = prepare(look_back(events, as_of, lookback, ts), vocab)
    records = materialize(score(model, rows, names))
    end = F.lit(as_of).cast("timestamp_ntz")
    header = class_summary(records).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
        F.date_format(end - F.expr(f"INTERVAL {lookback}"), "yyyy-MM-dd HH:mm:ss").alias("period_start"),
        F.lit(as_of).alias("period_end"), F.lit("random_forest").alias("model_used"), "*")
    if out_dir:
        write_records(header, records, f"{out_dir}/classification", [F.desc(ts), F.asc("id")])
    return header, records


def monitoring_job(weekly: DataFrame, forecast_row: DataFrame, out_dir: str | None = None) -> DataFrame:
    """L4: week-on-week table (W13), anomaly (A19/P23) and forecast comparison
    (J9) as one document; every part is bounded (8 weeks, one row each)."""
    from tremor.operators.joins import compare_forecast
    from tremor.plans.monitoring import anomaly, week_on_week

    wow = week_on_week(weekly, 8).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "nb_seismes", "diff",
                                         "pct", "trend", "is_current")
    table = wow.agg(ordered_records(wow, wow.columns, [("date", False)]).alias("last_8_weeks"))
    doc = attach_row(attach_row(anomaly(weekly, 8), compare_forecast(weekly, forecast_row)), table)
    if out_dir:
        write_document(doc, f"{out_dir}/weekly_report")
    return doc


def run_all(spark: SparkSession, events: DataFrame, as_of: str, out_dir: str, jobs: dict | None = None) -> DataFrame:
    """Run the jobs in sequence, logging ok/failed per step to
    ``out_dir/run_log`` with its real time (S12); returns the freshness table.  A failing job
    is logged and the next one still runs."""
    from tremor.plans.zones import risk_zones, zones_document
    jobs = jobs or {
        "classification": lambda: classification_job(events, as_of, out_dir, model_path=f"{out_dir}/classifier"),
        "forecast": lambda: forecast_job(events, as_of, out_dir).count(),
        "zones": lambda: write_document(zones_document(risk_zones(events, as_of), as_of), f"{out_dir}/zones"),
    }
    log = f"{out_dir}/run_log"
    for step, fn in jobs.items():
        try:
            fn()
            log_run(spark, log, step, "ok")
        except Exception as e:  # noqa: BLE001 — the failure is recorded, not hidden
            log_run(spark, log, step, "failed", str(e)[:500])
    return freshness(spark.read.parquet(log))
