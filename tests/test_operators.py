"""Unit tests on small literal frames."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tremor.functions.bands import anomaly_band, risk_tier, trend_band
from tremor.functions.weeks import iso_week, week_label
from tremor.operators import joins as J
from tremor.operators import stats as ST
from tremor.operators import windows as W
from tremor.operators.cleaning import dedup_first, dup_count, exclude, range_filter
from tremor.sources.history import upsert_period


def test_week_labels(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),), (dt.date(2024, 1, 7),)], "d date")
    rows = df.select(week_label("d", "w_mon_close").alias("a"), week_label("d", "iso_start").alias("b"),
                     week_label("d", "iso_end").alias("c")).collect()
    # Monday closes its own bin; Tuesday opens the next one
    assert [r.a for r in rows] == [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 8)]
    assert [r.b for r in rows] == [dt.date(2024, 1, 1)] * 3
    assert [r.c for r in rows] == [dt.date(2024, 1, 7)] * 3


def test_iso_week_edges(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2021, 1, 3),)], "d date")
    assert [r[0] for r in df.select(iso_week("d")).collect()] == [1, 53]


def test_interpolate_edge_rules(spark):
    vals = [None, 1.0, None, None, 4.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "date int, x double")
    out = [r.x for r in W.interpolate(df, ["x"], order="date").orderBy("date").collect()]
    assert out == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_rolling_min_periods_and_partition(spark):
    rows = [("a", i, float(i)) for i in range(6)] + [("b", i, 10.0 * i) for i in range(3)]
    df = spark.createDataFrame(rows, "zone string, date int, y double")
    out = W.add_rolling(df, "y", [3], "mean", by=["zone"], prefix="m").orderBy("zone", "date").collect()
    a = [r.m3 for r in out if r.zone == "a"]
    b = [r.m3 for r in out if r.zone == "b"]
    assert a[:3] == [None, None, None] and a[3] == 1.0 and a[5] == 3.0
    assert b == [None, None, None]  # never enough history, never leaks from zone a


def test_ts_folds_match_timeseries_split(spark):
    n, k = 23, 5
    df = spark.createDataFrame([(i,) for i in range(n)], "date int")
    out = W.ts_folds(df, k, "date").collect()
    test_size = n // (k + 1)
    for f in range(1, k + 1):
        start = n - (k - f + 1) * test_size
        train = sorted(r.date for r in out if r.fold == f and r.role == "train")
        val = sorted(r.date for r in out if r.fold == f and r.role == "val")
        assert train == list(range(0, start))
        assert val == list(range(start, start + test_size))


def test_fill_weeks_and_dense_grid(spark):
    d0 = dt.date(2024, 1, 1)
    wk = spark.createDataFrame([(d0, 3, 5.0), (d0 + dt.timedelta(days=21), 1, 7.0)],
                               "date date, nb_seismes bigint, mag_max double")
    full = J.fill_weeks(wk, zero_cols=("nb_seismes",), interp_cols=("mag_max",)).orderBy("date").collect()
    assert len(full) == 4
    assert [r.nb_seismes for r in full] == [3, 0, 0, 1]
    assert [r.mag_max for r in full] == [5.0, 5.0 + 2 / 3, 5.0 + 4 / 3, 7.0]
    zw = spark.createDataFrame([(d0, 1, 2), (d0 + dt.timedelta(days=14), 2, 5)], "date date, zone int, nb_seismes bigint")
    grid = J.dense_grid(zw).collect()
    assert len(grid) == 3 * 2 and sum(r.nb_seismes for r in grid) == 7


def test_upsert_idempotent(spark):
    hist = spark.createDataFrame([(1, 10), (2, 20)], "date int, n int")
    new = spark.createDataFrame([(2, 25), (3, 30)], "date int, n int")
    once = upsert_period(hist, new, "date")
    twice = upsert_period(once, new, "date")
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, 10), (2, 25), (3, 30)]


def test_filters_and_dedup(spark):
    df = spark.createDataFrame([(1, 5.0, 10.0, "quarry blast"), (2, None, 10.0, "quarry blast"),
                                (3, 3.0, 800.0, "earthquake"), (3, 3.0, 800.0, "earthquake")],
                               "id int, mag double, depth_km double, type string")
    assert [r.id for r in range_filter(df).collect()] == [1]
    kept = exclude(df, (F.col("type") == "quarry blast") & (F.col("mag") > 4))
    assert sorted(r.id for r in kept.collect()) == [2, 3, 3]  # NULL predicate keeps the row
    assert dup_count(df).first()[0] == 1
    ts = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("b", 5, 3)], "k string, time_utc int, id int")
    assert sorted(tuple(r) for r in dedup_first(ts, "k").collect()) == [("a", 1, 2), ("b", 5, 3)]


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in [60, 20, 0, -20, -60]], "d int")
    assert [r[0] for r in df.select(trend_band("d")).collect()] == [
        "forte_hausse", "hausse", "stable", "baisse", "forte_baisse"]
    df2 = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    assert [r[0] for r in df2.select(risk_tier("v", F.lit(1), F.lit(2))).collect()] == ["faible", "modere", "eleve"]
    df3 = spark.createDataFrame([(2.5,), (-1.5,), (0.2,)], "z double")
    assert [r[0] for r in df3.select(anomaly_band("z")).collect()] == ["anomalie", "inhabituel", "normal"]


def test_regression_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 100, 50).astype(float)
    yhat = y + rng.normal(0, 5, 50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, yhat)], "y double, yhat double")
    r = ST.regression_metrics(df).first()
    e = y - yhat
    assert math.isclose(r.mae, np.mean(np.abs(e)), rel_tol=1e-9)
    assert math.isclose(r.rmse, math.sqrt(np.mean(e * e)), rel_tol=1e-9)
    assert math.isclose(r.r2, 1 - np.sum(e * e) / np.sum((y - y.mean()) ** 2), rel_tol=1e-9)
    assert math.isclose(r.mape, np.mean(np.abs(e / (y + 1))) * 100, rel_tol=1e-9)


def test_class_metrics(spark):
    rows = [(0, 0), (0, 0), (1, 1), (1, 0), (2, 2), (2, 1)]
    r = ST.class_metrics(spark.createDataFrame(rows, "y int, yhat int")).first()
    assert math.isclose(r.accuracy, 4 / 6)
    f1 = [2 * (2 / 3) * 1 / ((2 / 3) + 1), 0.5, 2 * 1 * 0.5 / 1.5]
    assert math.isclose(r.f1_macro, sum(f1) / 3)


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 41)], "x double")
    h = {r.bin: r.n for r in ST.histogram(df, "x", 40).collect()}
    assert sum(h.values()) == 41 and max(h) == 40 and h[40] == 2


def test_zscore_zero_sd(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "date int, nb_seismes int")
    assert ST.zscore_last(df, 8).first().z_score == 0.0


def test_sample_n_equals_global_hash_order(spark):
    from tremor.operators.cleaning import sample_n, seeded_hash
    df = spark.range(0, 5000).withColumnRenamed("id", "id")
    got = sorted(r.id for r in sample_n(df, 300, seed=7).collect())
    want = sorted(r.id for r in df.orderBy(seeded_hash("id", 7), "id").limit(300).collect())
    assert got == want and len(got) == 300
    assert sample_n(df, 9000).count() == 5000


def test_weekly_series_closed_weeks_only(spark):
    from tremor.plans.weekly import weekly_series
    base = dt.datetime(2024, 1, 1)  # a Monday
    rows = [(i, base + dt.timedelta(days=i), 3.0, 10.0, 0, "p") for i in range(20)]  # Jan 1 .. Jan 20
    ev = spark.createDataFrame(rows, "id long, time_utc timestamp_ntz, mag double, depth_km double, tsunami int, place string")
    # W-MON bins end on Mondays: Jan 1, Jan 8, Jan 15 are closed on Wed Jan 17; the Jan 22 bin is open
    labels = [r.date for r in weekly_series(ev, closed_as_of="2024-01-17 12:00:00").orderBy("date").collect()]
    assert labels == [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 15)]
    iso = [r.date for r in weekly_series(ev, mode="iso_start", closed_as_of="2024-01-17 12:00:00").orderBy("date").collect()]
    assert iso == [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]


def test_closed_weeks_cutoff_on_a_bin_end_day(spark):
    from tremor.plans.weekly import weekly_series
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(days=i), 3.0, 10.0, 0, "p") for i in range(20)]
    ev = spark.createDataFrame(rows, "id long, time_utc timestamp_ntz, mag double, depth_km double, tsunami int, place string")
    # Monday Jan 15 noon: the bin ending that Monday is still open
    labels = [r.date for r in weekly_series(ev, closed_as_of="2024-01-15 12:00:00").orderBy("date").collect()]
    assert labels[-1] == dt.date(2024, 1, 8)
    labels = [r.date for r in weekly_series(ev, closed_as_of="2024-01-16 00:00:00").orderBy("date").collect()]
    assert labels[-1] == dt.date(2024, 1, 15)


def test_latest_metrics_with_runs_that_have_none(spark):
    from tremor.sources.history import latest_metrics
    h = spark.createDataFrame([("2024-01-01", "m", 17.0, 1.0, 0.1), ("2024-01-08", "m", 4.5, 2.0, 0.2), ("2024-01-15", "m", None, None, None),
                               ("2024-01-01", "zone", None, None, None)], "date string, model string, mae double, rmse double, r2 double")
    got = {r.model: r for r in latest_metrics(h).collect()}
    m, z = got["m"], got["zone"]
    assert (m.latest_date, m.latest_mae, m.latest_rmse, m.best_mae, m.best_date, m.runs) == ("2024-01-15", 4.5, 2.0, 4.5, "2024-01-08", 3)
    assert (z.latest_date, z.latest_mae, z.best_mae, z.best_date, z.runs) == ("2024-01-01", None, None, None, 1)


def test_freshness_of_runs_at_one_time(spark, tmpdir_path):
    from tremor.sources.history import freshness, log_run
    for status in ("failed", "ok"):
        log_run(spark, f"{tmpdir_path}/log", "zones", status, at="2024-01-01 00:00:00")
    row = freshness(spark.read.parquet(f"{tmpdir_path}/log")).first()
    assert (row.status, row.runs) == ("ok", 2)


def test_dedup_keeps_ids_without_a_time(spark):
    from tremor.operators.cleaning import dedup_first
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (2, t, "b"), (3, t, "b"), (3, t, "a"), (4, None, "b"), (4, None, "a")],
                               "id int, time_utc timestamp_ntz, v string")
    assert sorted((r.id, r.time_utc, r.v) for r in dedup_first(df, "id").collect()) == [(1, None, "a"), (2, t, "b"), (3, t, "a"), (4, None, "a")]


def test_class_of_a_missing_magnitude_is_missing(spark):
    from tremor.plans.classification import mag_class
    df = spark.createDataFrame([(None,), (3.9,), (4.0,), (6.0,)], "mag double")
    assert [r[0] for r in df.select(mag_class()).collect()] == [None, 0, 1, 2]


def test_boosting_keeps_the_rounds_that_help(spark):
    import numpy as np

    from tremor.operators import ml
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (260, 3))
    y = 40 + 9 * x[:, 0] - 6 * x[:, 1] ** 2 + rng.normal(0, 1, 260)
    df = spark.createDataFrame([(*map(float, a), float(b), i % 5 == 0) for i, (a, b) in enumerate(zip(x, y))],
                               "a double, b double, c double, nb_seismes double, is_val boolean").coalesce(1)

    def mae(model):
        return ml.predict(model, df.where("is_val"), ["a", "b", "c"]).agg(F.avg(F.abs(F.col("nb_seismes") - F.col("yhat")))).first()[0]

    full = ml.train_gbt(df, ["a", "b", "c"], max_iter=60, step=0.1, max_depth=3, validation_col="is_val", patience=30)
    one = ml.truncate(full, 1)
    assert full.getNumTrees > 20 and one.getNumTrees == 1
    assert mae(full) < 0.6 * mae(one)


def test_write_event_table_splits_a_month(spark, tmpdir_path):
    from tremor.sources.files import write_event_table
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t + dt.timedelta(minutes=i)) for i in range(20_000)], "id int, time_utc timestamp_ntz")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # else so few rows make one task
    try:
        write_event_table(df, f"{tmpdir_path}/events")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(f"{tmpdir_path}/events").inputFiles()) > 1
