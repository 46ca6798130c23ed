"""Streaming forms: dedup of re-delivered events, closed weeks equal the
batch rollup, idempotent per-batch upsert."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.streaming.events import (run_available, stream_dedup, stream_events, stream_upsert,
                                     stream_weekly)

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("time_utc", T.TimestampType()),
                       T.StructField("mag", T.DoubleType())])


def _rows(start_id, n, day0):
    base = dt.datetime(2024, 1, 1)
    return [(start_id + i, base + dt.timedelta(days=day0 + i * 0.5), 2.0 + (i % 5)) for i in range(n)]


def test_stream_dedup_and_weekly(spark, tmpdir_path):
    land = f"{tmpdir_path}/landing"
    a = _rows(0, 40, 0)
    b = a[30:] + _rows(40, 20, 20)  # re-delivers ids 30..39
    spark.createDataFrame(a, SCHEMA).coalesce(1).write.parquet(f"{land}/batch=1")
    spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{land}/batch=2")
    s = stream_events(spark, land, SCHEMA, pattern="batch=*", max_files=1)
    dedup = run_available(stream_dedup(s.drop("batch") if "batch" in s.columns else s, delay="30 days"), f"{tmpdir_path}/t_dedup")
    assert dedup.count() == 60 and dedup.select("id").distinct().count() == 60

    weekly = run_available(stream_weekly(stream_dedup(s, delay="1 day"), delay=None), f"{tmpdir_path}/t_weekly")
    got = {r.week_start: r.nb_seismes for r in weekly.collect()}
    allrows = spark.createDataFrame(a + _rows(40, 20, 20), SCHEMA)
    maxts = max(r[1] for r in a + _rows(40, 20, 20))
    batch = (allrows.groupBy(F.to_date(F.date_trunc("week", "time_utc")).alias("w")).count().collect())
    closed = {r.w: r["count"] for r in batch
              if dt.datetime.combine(r.w, dt.time()) + dt.timedelta(days=7) <= maxts - dt.timedelta(days=1)}
    assert got == closed and len(closed) >= 3


def test_stream_upsert_idempotent(spark, tmpdir_path):
    land = f"{tmpdir_path}/landing2"
    spark.createDataFrame(_rows(0, 30, 0), SCHEMA).coalesce(1).write.parquet(f"{land}/batch=1")
    spark.createDataFrame(_rows(30, 10, 3), SCHEMA).coalesce(1).write.parquet(f"{land}/batch=2")  # late rows for old weeks
    s = stream_events(spark, land, SCHEMA, pattern="batch=*", max_files=1).withWatermark("time_utc", "30 days")
    agg = (s.groupBy(F.window("time_utc", "7 days", startTime="4 days").alias("w"))
           .agg(F.count(F.lit(1)).alias("n"))
           .select(F.date_format("w.start", "yyyy-MM-dd").alias("week_start"), "n"))
    table = f"{tmpdir_path}/upsert_table"
    out = {str(r.week_start): r.n for r in stream_upsert(agg, table).collect()}
    every = spark.createDataFrame(_rows(0, 30, 0) + _rows(30, 10, 3), SCHEMA)
    want = {r.w: r["count"] for r in every.groupBy(
        F.date_format(F.date_trunc("week", "time_utc"), "yyyy-MM-dd").alias("w")).count().collect()}
    assert out == want


def test_stream_sliding_windows_equal_batch_when_closed(spark, tmpdir_path):
    from tremor.streaming.events import sliding_counts
    land = f"{tmpdir_path}/landing3"
    rows = _rows(0, 60, 0)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{land}/batch=1")
    s = stream_events(spark, land, SCHEMA, pattern="batch=*").withWatermark("time_utc", "1 hour")
    got = {(r.window_start, r.n) for r in run_available(sliding_counts(s), f"{tmpdir_path}/t_slide").collect()}
    batch = sliding_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    maxts = max(r[1] for r in rows)
    closed = {(r.window_start, r.n) for r in batch if r.window_end <= maxts - dt.timedelta(hours=1)}
    assert got == closed and len(closed) > 10


def test_second_run_reads_only_new_files(spark, tmpdir_path):
    land, place = f"{tmpdir_path}/landing4", f"{tmpdir_path}/place"
    a = _rows(0, 20, 0)
    spark.createDataFrame(a, SCHEMA).coalesce(1).write.parquet(f"{land}/batch=1")

    def run():
        s = stream_events(spark, land, SCHEMA, pattern="batch=*").withColumn("file", F.input_file_name())
        return run_available(stream_dedup(s, delay="30 days").select("id", "file"), place)

    assert run().count() == 20
    files = spark.read.parquet(f"{place}/table").inputFiles()
    assert run().count() == 20                                   # nothing new: nothing read, nothing written
    assert sorted(spark.read.parquet(f"{place}/table").inputFiles()) == sorted(files)
    spark.createDataFrame(a[10:] + _rows(20, 10, 10), SCHEMA).coalesce(1).write.parquet(f"{land}/batch=2")
    out = run()                                                  # ids 10..19 are known from the kept state
    assert out.count() == 30 and out.select("id").distinct().count() == 30
    assert {r.id for r in out.where(F.col("file").rlike("batch(=|%3D)2")).collect()} == set(range(20, 30))
