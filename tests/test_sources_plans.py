"""Sources/sinks round trips, documents, and end-to-end checks of the
registered catalogue (entry smoke, SQL twins on sf0.001, invariants)."""

import json
import os

import duckdb
import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF_SMALL
from tremor.sources import files as FS
from tremor.sources.documents import to_document
from tremor.sources.history import freshness, latest_metrics, log_run
from tremor.sources.tables import TABLES, table_path


def test_geojson_scan(spark, tmpdir_path):
    doc = {"type": "FeatureCollection", "features": [
        {"id": "a", "properties": {"mag": 4.2, "time": 1704067200000, "type": "earthquake", "tsunami": 1, "net": "us"},
         "geometry": {"coordinates": [10.5, -3.25, 12.0]}},
        {"id": "b", "properties": {"mag": None, "time": 1704067260000, "type": "quarry blast"},
         "geometry": {"coordinates": [1.0, 2.0]}}]}
    with open(os.path.join(tmpdir_path, "d.json"), "w") as f:
        json.dump(doc, f)
    rows = {r.id: r for r in FS.read_geojson(spark, tmpdir_path).collect()}
    assert rows["a"].longitude == 10.5 and rows["a"].latitude == -3.25 and rows["a"].depth_km == 12.0
    assert str(rows["a"].time_utc) == "2024-01-01 00:00:00"
    assert rows["b"].mag is None and rows["b"].depth_km is None and rows["b"].tsunami is None


def test_csv_roundtrip_and_document_read(spark, tmpdir_path):
    df = spark.createDataFrame([("2024-01-01", 3)], "date string, n int").withColumn("date", F.to_date("date"))
    FS.write_csv(df, f"{tmpdir_path}/csv")
    back = FS.read_csv(spark, f"{tmpdir_path}/csv", T.StructType([T.StructField("date", T.DateType()),
                                                                   T.StructField("n", T.IntegerType())]))
    assert back.collect() == df.collect()
    with open(f"{tmpdir_path}/fc.json", "w") as f:
        json.dump({"next_week_start": "2024-01-08", "prediction": {"central": 40, "low": 30, "high": 55}}, f)
    schema = "next_week_start string, prediction struct<central int, low int, high int>"
    d = FS.read_document(spark, f"{tmpdir_path}/fc.json", T._parse_datatype_string(schema))
    assert d.select("prediction.central").first()[0] == 40


def test_document_order_and_empty(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 7)], "zone int, pred int")
    doc = to_document(df, {"n": F.count(F.lit(1))}, "zones", ["zone", "pred"], [("pred", True)]).first()
    assert doc.n == 3 and [z.zone for z in doc.zones] == [2, 3, 1]
    empty = to_document(df.where("zone > 9"), {"n": F.count(F.lit(1))}, "zones", ["zone", "pred"], [("pred", True)]).first()
    assert empty.n == 0 and empty.zones == []


def test_run_log_and_metric_history(spark, tmpdir_path):
    p = f"{tmpdir_path}/log"
    log_run(spark, p, "forecast", "ok", at="2024-01-01 00:00:00")
    log_run(spark, p, "forecast", "failed", "timeout", at="2024-01-02 00:00:00")
    r = freshness(spark.read.parquet(p)).first()
    assert r.status == "failed" and r.runs == 2
    hist = spark.createDataFrame([("2026-06-07", "xgb", 17.0, 28.67, 0.859), ("2026-06-14", "xgb", 4.5, 5.88, 0.994),
                                  ("2026-06-07", "zone_1", None, None, None)],
                                 "date string, model string, mae double, rmse double, r2 double")
    m = {r.model: r for r in latest_metrics(hist).collect()}
    assert m["xgb"].latest_mae == 4.5 and m["xgb"].best_date == "2026-06-14" and m["zone_1"].best_mae is None


def test_model_save_load(spark, tmpdir_path):
    from tremor.operators.geo import assign_zone_model, fit_zones
    from tremor.sources.views import quake
    q = quake(spark, SF_SMALL).select("id", "latitude", "longitude")
    scaler, km = fit_zones(q, k=4, seed=1, max_iter=5)
    FS.save_model(km, f"{tmpdir_path}/km")
    km2 = FS.load_model(KMeansModel, f"{tmpdir_path}/km")
    a = assign_zone_model(q, scaler, km).select("id", "zone").collect()
    b = assign_zone_model(q, scaler, km2).select("id", "zone").collect()
    assert a == b


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0 and "nb_seismes" in df.columns


def test_oracle_keys_subset():
    import __spark_entry__ as entry
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 80


FAST = ["weekly_features", "A5_A6_zone_weekly", "J4_fill_weeks", "J5_W8_W9_zone_features", "L3_risk_zones",
        "W13_P21_P24_P32_week_on_week", "M14_decompose_zone", "A12_corr_target", "P36_J8_knn_impute",
        "T3_stream_weekly"]


@pytest.mark.parametrize("name", FAST)
def test_sql_twin_sf0001(spark, name):
    """Spark result equals its DuckDB twin on sf0.001 (gaps in weeks and grid)."""
    import __spark_entry__ as entry
    from tools.check_oracle import _digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    sdf = entry.queries()[name](spark, SF_SMALL)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    srows, drows = [tuple(r) for r in sdf.collect()], [tuple(r) for r in res.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _digest(sdf.columns, srows)[0] == _digest(dcols, drows)[0]


def test_risk_zone_invariants(spark):
    import __spark_entry__ as entry
    z = entry.queries()["L3_risk_zones"](spark, SF_SMALL).collect()
    assert {r.risk_level for r in z} <= {"faible", "modere", "eleve"}
    assert len({r.zone for r in z}) == len(z)


def test_forecast_interval_order(spark):
    import __spark_entry__ as entry
    r = entry.queries()["M13_forecast_next"](spark, SF_SMALL).first()
    assert 0 <= r.low <= r.central <= r.high
    doc = json.loads(r.document)
    assert len(doc["history_12w"]) == 12 and doc["history_12w"][0]["date"] < doc["history_12w"][-1]["date"]


def test_write_periods_rewrites_only_touched_partitions(spark, tmpdir_path):
    from tremor.sources.history import write_periods
    path = f"{tmpdir_path}/hist"
    write_periods(spark.createDataFrame([("2024-01-01", 1), ("2024-01-08", 2)], "date string, n int"), path)
    write_periods(spark.createDataFrame([("2024-01-08", 5), ("2024-01-15", 7)], "date string, n int"), path)
    write_periods(spark.createDataFrame([("2024-01-08", 5), ("2024-01-15", 7)], "date string, n int"), path)
    got = sorted((str(r.date), r.n) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01-01", 1), ("2024-01-08", 5), ("2024-01-15", 7)]


def test_forecast_job_and_runner(spark, tmpdir_path):
    from tremor.plans.jobs import run_all
    from tremor.sources.views import quake_long
    events = quake_long(spark, SF_SMALL)
    fr = {r.step: r for r in run_all(spark, events, "2001-08-01 12:00:00", tmpdir_path).collect()}
    assert fr["forecast"].status == "ok" and fr["zones"].status == "ok"
    doc = spark.read.json(f"{tmpdir_path}/forecast").first()
    assert doc.prediction.low <= doc.prediction.central <= doc.prediction.high
    assert doc.current_week.start == "2001-08-05"  # Sunday label of the as_of week (serving convention)
    hist = spark.read.parquet(f"{tmpdir_path}/weekly_history")
    assert hist.where("date = '2001-08-05'").count() == 1


def test_classification_and_monitoring_jobs(spark, tmpdir_path):
    from tremor.plans.jobs import classification_job, forecast_job, monitoring_job
    from tremor.plans.weekly import weekly_series
    from tremor.sources.views import quake, quake_long
    header, records = classification_job(quake(spark, SF_SMALL), "2024-01-29 12:00:00", tmpdir_path,
                                         model_path=f"{tmpdir_path}/rf")
    h = header.first()
    assert h.total == h.count_faible + h.count_modere + h.count_strong == records.count()
    again, _ = classification_job(quake(spark, SF_SMALL), "2024-01-29 12:00:00", None, model_path=f"{tmpdir_path}/rf")
    assert again.first().total == h.total  # second run loads the saved model
    weekly = weekly_series(quake_long(spark, SF_SMALL))
    fc = forecast_job(quake_long(spark, SF_SMALL), "2001-08-01 12:00:00").select(
        "next_week_start", "prediction.central", "prediction.low", "prediction.high")
    doc = monitoring_job(weekly, fc, tmpdir_path).first()
    assert len(doc.last_8_weeks) == 8 and doc.anomaly in {"anomalie", "inhabituel", "normal"}


def test_consistent_rows_shift_newest_week_into_prediction_row(spark):
    from pyspark.sql import functions as F
    from tremor.plans.weekly import consistent_training_rows, weekly_series
    from tremor.sources.views import quake_long
    weekly = weekly_series(quake_long(spark, SF_SMALL))
    rows = consistent_training_rows(weekly).orderBy(F.desc("date")).limit(2).collect()
    future, newest = rows[0], rows[1]
    assert future.nb_seismes is None and future.lag_1 == newest.nb_seismes
    assert future.prev_nb_zones == newest.nb_zones and future.prev_mag_max == newest.mag_max
    import __spark_entry__ as entry
    r = entry.queries()["M13_forecast_next_consistent"](spark, SF_SMALL).first()
    assert 0 <= r.low <= r.central <= r.high


def test_geojson_documents_are_bounded_and_round_trip(spark, tmpdir_path):
    from tremor.sources.views import quake
    ev = quake(spark, SF_SMALL)
    docs = FS.to_geojson_lines(ev, batch=100)
    sizes = [len(json.loads(r.value)["features"]) for r in docs.collect()]
    assert max(sizes) <= 100 and sum(sizes) == ev.count()
    docs.write.mode("overwrite").text(f"{tmpdir_path}/gj")
    back = FS.read_geojson(spark, f"{tmpdir_path}/gj", multiline=False)
    assert back.count() == ev.count() and back.select("id").distinct().count() == ev.count()


def test_recommended_conf():
    from tremor.session import recommended_conf
    c = recommended_conf(100 * (1 << 40), 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (128 << 20)
    assert int(recommended_conf(1 << 20, 16)["spark.sql.shuffle.partitions"]) == 32


def test_risk_zones_stale_as_zero(spark):
    from tremor.plans.zones import risk_zones
    from tremor.sources.views import quake
    ev = quake(spark, SF_SMALL)
    # an as_of after the data: no zone has events in the current week
    ref = {r.zone: r.pred_seismes for r in risk_zones(ev, "2024-02-20 12:00:00").collect()}
    zero = {r.zone: r.pred_seismes for r in risk_zones(ev, "2024-02-20 12:00:00", stale_as_zero=True).collect()}
    assert ref.keys() == zero.keys() and all(v > 0 for v in ref.values()) and set(zero.values()) == {0}
