"""Structured Streaming forms of the polling jobs.

The reference re-polls look-back windows every 6 hours and replaces the
current period's row; here a file stream ingests new event files, state
is kept by Spark (watermarked windows, dedup), and restated periods are
upserted per micro-batch.  Checkpoints and output tables live under the
session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.session import checkpoint_dir


def stream_events(spark: SparkSession, landing: str, schema: T.StructType, pattern: str = "*",
                  fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Incremental ingest of new files from a landing folder (explicit schema)."""
    r = spark.readStream.schema(schema).option("basePath", landing)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.format(fmt).load(f"{landing.rstrip('/')}/{pattern}")


def with_event_time(df: DataFrame, ts: str = "time_utc") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session zone is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedup(df: DataFrame, key: str = "id", ts: str = "time_utc", delay: str = "1 day") -> DataFrame:
    """Drop re-delivered events (same id) within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_weekly(df: DataFrame, ts: str = "time_utc", delay: str | None = "1 day") -> DataFrame:
    """Monday-aligned tumbling weeks (epoch day 0 is a Thursday, so a
    4-day start offset aligns windows on Monday) with a watermark.

    ``delay=None`` keeps the watermark already defined upstream (e.g. by
    :func:`stream_dedup`); a stream may define it only once.
    """
    wm = df.withWatermark(ts, delay) if delay else df
    return (wm
            .groupBy(F.window(ts, "7 days", startTime="4 days").alias("w"))
            .agg(F.count(F.lit(1)).alias("nb_seismes"), F.max("mag").alias("mag_max"))
            .select(F.to_date("w.start").alias("week_start"), "nb_seismes", "mag_max"))


def sliding_counts(df: DataFrame, ts: str = "time_utc", length: str = "24 hours", slide: str = "6 hours") -> DataFrame:
    """T4: sliding look-back counts (batch or stream); slide = refresh period."""
    return (df.groupBy(F.window(ts, length, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))


def stream_place(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, for a stream that is
    run once (jobs that resume pass their own)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def run_available(df: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over everything available now into the Parquet
    table ``place``/table and return a scan of it.

    ``place``/checkpoint holds file offsets, state and the sink's log: a
    later run with the same ``place`` reads only new files, continues the
    state and adds to the table, and a replayed batch is written once.
    Nothing passes through the driver.
    """
    spark = df.sparkSession
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}/checkpoint")
         .trigger(availableNow=True).start(f"{place}/table"))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/table")


def stream_upsert(agg: DataFrame, place: str, key: str = "week_start") -> DataFrame:
    """T5: update-mode aggregate; each micro-batch's changed periods replace
    their rows in the Parquet table ``place``/table partitioned by the period
    (dynamic partition overwrite, so a replayed batch rewrites the same
    partitions — idempotent).  ``place``/checkpoint resumes as in
    :func:`run_available`.  Returns the table after all available data."""
    spark = agg.sparkSession
    table = f"{place}/table"

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # the writer option (not a session conf): foreachBatch runs on a
        # cloned session, so only per-write settings are guaranteed to apply
        (batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(key).parquet(table))

    q = (agg.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(agg.schema).parquet(table)
