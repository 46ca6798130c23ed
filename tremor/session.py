"""Session construction and lineage cutting.

On a cluster the session comes from the platform; we only add settings
that are unset.  ``spark.checkpoint.dir`` is read from the session and a
scratch folder is chosen only when nothing is configured (tests, local).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tremor") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TREMOR_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir``.

    A scratch folder is created only for local masters (tests, single-node
    runs); on a cluster an unset folder is an error, never a machine-local
    path that other executors could not read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) for this job")
    local = tempfile.mkdtemp(prefix="tremor-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a small derived table (a rollup) once when several branches of
    a plan read it, so the events behind it are scanned once.  Same reliable
    checkpoint as :func:`cut_lineage`."""
    return cut_lineage(df)


DEAL_ROWS = 250_000             # rows a task, of a table that is read many times


def deal_evenly(df: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` rows in equal parts, so that each pass over it (a level of
    a forest, a scoring) keeps every core busy: files and joins give parts of
    very unequal size, or fewer than there are cores.  Rows are dealt by the hash of all
    their columns, so a repeated or missing key goes to many tasks.  One of at
    most ``DEAL_ROWS`` rows stays as it lies."""
    if rows <= DEAL_ROWS:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    # whole rounds of all cores, two at least: no round is left half empty
    return df.repartition(cores * max(2, -(-rows // (DEAL_ROWS * cores))), F.xxhash64(*df.columns))


def recommended_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings for a job reading ``input_bytes`` on ``total_cores`` cores.

    Scan splits of ~256 MB, an initial shuffle width of input / 128 MB
    (at least 2x the cores), which AQE coalesces toward the advisory size
    for the small post-rollup stages and splits for skewed partitions.
    """
    width = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.shuffle.partitions": str(width),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
