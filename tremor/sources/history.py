"""History tables: period upsert (S10/J6), run-status log (S12), metric
history (S13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_period(history: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """Drop the history rows of the periods present in ``new`` and
    append ``new`` (idempotent: applying the same batch twice is a no-op).

    The period list is a distinct over the new batch; the anti join is a
    shuffle (or broadcast, chosen by AQE at run time) on the period key.
    """
    periods = new.select(key).distinct()
    kept = history.join(periods, key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def write_periods(df: DataFrame, path: str, key: str = "date") -> None:
    """S10 on a file table: rewrite only the partitions of the periods in
    ``df`` (dynamic partition overwrite), leaving other periods untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def log_run(spark: SparkSession, path: str, step: str, status: str, message: str = "",
            at: str | None = None) -> None:
    """Append one status row for a pipeline step.  ``last_run`` is the
    real time unless ``at`` is given; ``seq`` (microseconds of the append)
    orders runs logged for the same time."""
    ts = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    row = spark.range(1).select(ts.alias("last_run"), F.unix_micros(F.current_timestamp()).alias("seq"), F.lit(step).alias("step"),
                                F.lit(status).alias("status"), F.lit(message).alias("message"))
    row.write.mode("append").parquet(path)


def freshness(log: DataFrame) -> DataFrame:
    """Latest status and time per step (one aggregate).  Runs of one time
    are ordered by ``seq``; rows without a time never win over others."""
    latest = F.struct("last_run", "seq", "status", "message")
    return log.groupBy("step").agg(
        F.max("last_run").alias("last_run"),
        F.max_by("status", latest).alias("status"),
        F.max_by("message", latest).alias("message"),
        F.count(F.lit(1)).alias("runs"))


def latest_metrics(hist: DataFrame, date: str = "date", model: str = "model") -> DataFrame:
    """Latest and best (lowest MAE, then earliest) run per model.

    Runs without an MAE (zone rows carry none) count in ``runs`` and
    ``latest_date``, the date of the last run; the latest and best metrics
    come from runs that have one."""
    measured = F.col("mae").isNotNull()
    last = F.when(measured, F.struct(date, "mae", "rmse", "r2"))
    return hist.groupBy(model).agg(
        F.max(date).alias("latest_date"),
        F.max_by("mae", last).alias("latest_mae"),
        F.max_by("rmse", last).alias("latest_rmse"),
        F.max_by("r2", last).alias("latest_r2"),
        F.min("mae").alias("best_mae"),
        F.min_by(date, F.when(measured, F.struct("mae", date))).alias("best_date"),
        F.count(F.lit(1)).alias("runs"))


def output_freshness(spark: SparkSession, folder: str, outputs: list[str], suffix: str = ".parquet") -> DataFrame:
    """Freshness per expected output — exists, last modification, size.

    The folder listing comes from the ``binaryFile`` source with only path,
    time and length selected, so file contents are never read.
    """
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
               .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
                       F.col("modificationTime").alias("updated_at"), F.col("length").alias("size_bytes")))
    expected = spark.createDataFrame([(o, f"{o}{suffix}") for o in outputs], "output string, file string")
    return (expected.join(listing, "file", "left")
            .select("output", F.col("updated_at").isNotNull().alias("exists"), "updated_at",
                    F.round(F.col("size_bytes") / 1024.0, 1).alias("size_kb")))
