"""State tables that follow a stream (T3, T5, T6; A1): mergeable parts, one a batch.

A restated week is merged from what its batches left behind, so no event is
read twice.  A batch writes one part per week it touches: counts, sums,
extremes and two sketches, HyperLogLog of the places and KLL of the
magnitudes.  Parts of a week add up in any order, so the week's row needs only
them.  A part is stored under its batch's number and overwritten when the
batch is replayed: nothing counts twice.

Distinct places and the median are sketch estimates, within ``ZONES_ERROR``
(relative) and ``MEDIAN_RANK_ERROR`` (rank) of the exact values with high
probability; all other columns are exact.  ``exact_weeks`` is the mode beside
it: it recomputes the given weeks from the events.

The scaler moments of T6 are one row per batch: the totals up to and with that
batch.  A batch reads the newest version before its own, so a replay finds
what the first run found.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions.scalars import energy
from tremor.functions.weeks import week_label
from tremor.operators.rollup import weekly_rollup

HLL_BITS, KLL_SIZE = 14, 800            # sketch sizes
ZONES_ERROR, MEDIAN_RANK_ERROR = 0.03, 0.01

#: week rows: what of them is exact, and what is estimated
EXACT = ["nb_seismes", "mag_max", "mag_mean", "depth_mean", "tsunami_sum", "energy_sum"]
ESTIMATED = ["nb_zones", "mag_median"]


def week_parts(events: DataFrame, ts: str = "time_utc", mode: str = "w_mon_close") -> DataFrame:
    """One mergeable row per week of the events.  NaN magnitudes are missing."""
    mag = F.when(~F.isnan(F.col("mag").cast("double")), F.col("mag").cast("double"))
    return events.where(F.col(ts).isNotNull()).groupBy(week_label(ts, mode).alias("date")).agg(
        F.count("id").alias("n"), F.count(mag).alias("mag_n"), F.sum(mag).alias("mag_sum"), F.max(mag).alias("mag_max"),
        F.count("depth_km").alias("depth_n"), F.sum("depth_km").alias("depth_sum"),
        F.sum(F.col("tsunami").cast("bigint")).alias("tsunami_sum"), F.sum(energy("mag")).alias("energy_sum"),
        F.hll_sketch_agg("place", F.lit(HLL_BITS)).alias("places"), F.kll_sketch_agg_double(mag, F.lit(KLL_SIZE)).alias("mags"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts of the same week as one part."""
    sums = ["n", "mag_n", "mag_sum", "depth_n", "depth_sum", "tsunami_sum", "energy_sum"]
    return parts.groupBy("date").agg(*[F.sum(c).alias(c) for c in sums], F.max("mag_max").alias("mag_max"),
                                     F.hll_union_agg("places").alias("places"), F.kll_merge_agg_double("mags", F.lit(KLL_SIZE)).alias("mags"))


def week_rows(parts: DataFrame) -> DataFrame:
    """The weeks' rows (the columns of the weekly rollup) from their parts."""
    median = F.when(F.col("mag_n") > 0, F.kll_sketch_get_quantile_double("mags", F.lit(0.5)))
    return merge_parts(parts).select(
        "date", F.col("n").alias("nb_seismes"), "mag_max", F.try_divide("mag_sum", "mag_n").alias("mag_mean"), median.alias("mag_median"),
        F.try_divide("depth_sum", "depth_n").alias("depth_mean"), "tsunami_sum", F.hll_sketch_estimate("places").alias("nb_zones"), "energy_sum")


def write_parts(parts: DataFrame, place: str, batch: int) -> None:
    """The parts of a batch, in place of what the batch wrote before."""
    (parts.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(f"{place}/parts"))


def read_parts(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.parquet(f"{place}/parts")


def stream_weeks(events: DataFrame, place: str, ts: str = "time_utc", mode: str = "w_mon_close") -> DataFrame:
    """Runs the stream over all available events and returns the weeks'
    rows.  A later run with the same ``place`` reads only new files and adds
    their parts; weeks they touch are restated by the merge.  Deduplicate
    upstream (:func:`tremor.streaming.events.stream_dedup`)."""

    def keep(batch: DataFrame, number: int) -> None:
        write_parts(week_parts(batch, ts, mode), place, number)

    query = (events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return week_rows(read_parts(events.sparkSession, place))


def exact_weeks(events: DataFrame, weeks: DataFrame, ts: str = "time_utc", mode: str = "w_mon_close") -> DataFrame:
    """The exact rows of the given weeks (column ``date``) from the events."""
    dated = events.withColumn("__week", week_label(ts, mode))
    return weekly_rollup(dated.join(weeks.select(F.col("date").alias("__week")).distinct(), "__week", "left_semi"), ts=ts, mode=mode)


def sketch_check(rows: DataFrame, exact: DataFrame, events: DataFrame, ts: str = "time_utc", mode: str = "w_mon_close") -> DataFrame:
    """Week rows with the errors of their estimates: ``zones_error`` (relative)
    and ``median_rank`` (the shares of the week's magnitudes below, and at or
    below, the estimated median)."""
    mag = F.col("mag").cast("double")
    ranked = (events.where(F.col(ts).isNotNull()).select(week_label(ts, mode).alias("date"), mag.alias("__m"))
              .where(F.col("__m").isNotNull() & ~F.isnan("__m")).join(rows.select("date", F.col("mag_median").alias("__e")), "date").groupBy("date")
              .agg(F.avg((F.col("__m") < F.col("__e")).cast("double")).alias("rank_below"),
                   F.avg((F.col("__m") <= F.col("__e")).cast("double")).alias("rank_within")))
    both = rows.join(exact.select("date", F.col("nb_zones").alias("__z")), "date").join(ranked, "date", "left")
    return both.withColumn("zones_error", F.try_divide(F.abs(F.col("nb_zones") - F.col("__z")), F.col("__z"))).drop("__z")


# ---- T6: scaler moments ---------------------------------------------------

def moments(events: DataFrame, cols=("latitude", "longitude")) -> DataFrame:
    """One row: n, sum and sum of squares of each column (rows that have both)."""
    have = F.lit(True)
    for c in cols:
        have = have & F.col(c).isNotNull()
    return events.where(have).agg(*[f(c) for c in cols for f in (
        lambda c: F.count(c).alias(f"{c}_n"), lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(f"{c}_s"),
        lambda c: F.coalesce(F.sum(F.col(c).cast("double") * F.col(c)), F.lit(0.0)).alias(f"{c}_ss"))])


def spread(col: str) -> Column:
    """The population standard deviation from a column's moments; 1 for a
    constant column or none (as the scaler does)."""
    n, s, ss = F.col(f"{col}_n"), F.col(f"{col}_s"), F.col(f"{col}_ss")
    variance = F.try_divide(ss, n) - F.pow(F.try_divide(s, n), F.lit(2))
    return F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0)).alias(f"{col}_sd")


class MomentTable:
    """Versioned totals under ``place``/moments, one row per batch."""

    def __init__(self, spark: SparkSession, place: str, cols=("latitude", "longitude")):
        self.spark, self.path, self.cols = spark, f"{place}/moments", tuple(cols)
        self.schema = ", ".join(f"{c}_n bigint, {c}_s double, {c}_ss double" for c in cols) + ", batch bigint"

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":            # before the first batch
                raise
            return self.spark.createDataFrame([], self.schema)

    def advance(self, batch: DataFrame, number: int) -> DataFrame:
        """Adds a batch to the newest version before it; returns the one row of
        its own version."""
        before = self.versions().where(F.col("batch") < number).orderBy(F.desc("batch")).limit(1).drop("batch")
        names = [f"{c}_{k}" for c in self.cols for k in ("n", "s", "ss")]
        total = before.unionByName(moments(batch, self.cols)).agg(*[F.sum(c).alias(c) for c in names])
        (total.withColumn("batch", F.lit(number).cast("bigint")).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path))
        return self.versions().where(F.col("batch") == number)

    def scales(self, version: DataFrame) -> DataFrame:
        return version.select(*[spread(c) for c in self.cols])


def stream_scaled(events: DataFrame, place: str, assign, cols=("latitude", "longitude")) -> DataFrame:
    """Each batch adds its moments to the state and is assigned by the
    scales up to and with itself; ``assign`` takes the batch with the columns
    ``<col>_sd`` and returns the rows to keep, stored under the batch's number."""
    from tremor.operators.common import attach_row
    table = MomentTable(events.sparkSession, place, cols)

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            scales = table.scales(table.advance(batch, number))
            (assign(attach_row(batch, scales)).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{place}/table"))
        finally:
            batch.unpersist()

    query = (events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return events.sparkSession.read.parquet(f"{place}/table")
