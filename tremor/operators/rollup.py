"""Grouped rollups.

All rollups are one ``groupBy().agg()`` each: Spark plans a partial
(map-side) aggregate before the shuffle, so a hot week or zone is
pre-combined in every task and never travels as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.scalars import energy
from tremor.functions.weeks import week_label
from tremor.operators.common import attach_row
from tremor.operators.quantiles import SMALL, exact_quantile, largest_group, listed_quantile


def weekly_rollup(df: DataFrame, ts: str = "time_utc", mode: str = "w_mon_close",
                  by: list[str] | None = None, exact_median: bool = True,
                  with_energy: bool = True) -> DataFrame:
    """A1 + A3: one row per week (and ``by`` keys) with count, magnitude stats,
    mean depth, tsunami sum, distinct places and (optionally) energy sum.

    ``exact_median``: True (exact with bounded memory,
    :mod:`tremor.operators.quantiles`: inside the same aggregate where every
    group is small, else over one projection of the events) or False (a
    quantile sketch inside the same aggregate).

    Energy is fused into the same aggregate instead of a second pass + join
    (the notebook's J1); NULL magnitudes are skipped (SURVEY D7).
    """
    keys = [week_label(ts, mode).alias("date")] + [F.col(k) for k in (by or [])]
    src = df.where(F.col(ts).isNotNull())
    group = ["date"] + list(by or [])
    inside = not exact_median or largest_group(src.withColumn("date", week_label(ts, mode)), "mag", group) <= SMALL
    median = listed_quantile("mag", 0.5) if exact_median else F.percentile_approx("mag", 0.5, 10000)
    aggs = [
        F.count("id").alias("nb_seismes"),
        F.max("mag").alias("mag_max"),
        F.avg("mag").alias("mag_mean"),
        *([median.alias("mag_median")] if inside else []),
        F.avg("depth_km").alias("depth_mean"),
        F.sum(F.col("tsunami").cast("bigint")).alias("tsunami_sum"),
        F.countDistinct("place").alias("nb_zones"),
    ]
    if with_energy:
        aggs.append(F.sum(energy("mag")).alias("energy_sum"))
    out = src.groupBy(*keys).agg(*aggs)
    if inside:
        return out
    med = exact_quantile(src.withColumn("date", week_label(ts, mode)), "mag", 0.5, group, out="mag_median")
    cols = out.columns
    cut = 4 + len(by or [])  # keys, nb_seismes, mag_max, mag_mean | mag_median | the rest
    right = med.select(*[F.col(c).alias(f"__m_{c}") for c in group], "mag_median")
    same = [out[c].eqNullSafe(right[f"__m_{c}"]) for c in group]
    return out.join(right, same, "left").select(*cols[:cut], "mag_median", *cols[cut:])


def weekly_energy(df: DataFrame, ts: str = "time_utc", mode: str = "w_mon_close") -> DataFrame:
    """A3: weekly sum of 10^(1.5*mag)."""
    return (df.where(F.col(ts).isNotNull())
            .groupBy(week_label(ts, mode).alias("date"))
            .agg(F.sum(energy("mag")).alias("energy_sum")))


def week_snapshot(df: DataFrame, as_of: str, ts: str = "time_utc",
                  null_mag_as_zero: bool = False) -> DataFrame:
    """A2: single-row rollup of the Monday..Sunday week containing ``as_of``.

    Energy skips NULL magnitudes as the history rows do (SURVEY D7);
    ``null_mag_as_zero`` counts them as magnitude 0 (the serving variant).

    A global aggregate always yields exactly one row; ``coalesce`` gives the
    zero defaults of an empty week (S9).  The label is the week's Sunday.
    """
    start = F.date_trunc("week", F.lit(as_of).cast("timestamp_ntz"))
    end = start + F.expr("INTERVAL 7 DAYS")
    wk = df.where((F.col(ts) >= start) & (F.col(ts) < end) & (F.col("type") == "earthquake")
                  if "type" in df.columns else (F.col(ts) >= start) & (F.col(ts) < end))
    inside = largest_group(wk, "mag", []) <= SMALL
    agg = wk.agg(
        F.count(F.lit(1)).alias("nb_seismes"),
        F.coalesce(F.max("mag"), F.lit(0.0)).alias("mag_max"),
        F.coalesce(F.avg("mag"), F.lit(0.0)).alias("mag_mean"),
        F.coalesce(F.avg("depth_km"), F.lit(0.0)).alias("depth_mean"),
        F.coalesce(F.sum(F.coalesce(F.col("tsunami"), F.lit(0)).cast("bigint")), F.lit(0).cast("bigint")).alias("tsunami_sum"),
        F.countDistinct("place").alias("nb_zones"),
        F.coalesce(F.sum(energy("mag", null_as_zero=null_mag_as_zero)), F.lit(0.0)).alias("energy_sum"),
        *([listed_quantile("mag", 0.5).alias("mag_median")] if inside else []),
    )
    if not inside:
        agg = attach_row(agg, exact_quantile(wk, "mag", 0.5, [], out="mag_median"))
    agg = agg.select(
        "nb_seismes", "mag_max", "mag_mean", F.coalesce("mag_median", F.lit(0.0)).alias("mag_median"),
        "depth_mean", "tsunami_sum", "nb_zones", "energy_sum")
    return agg.select(F.date_add(F.to_date(start), 6).alias("date"), "*")


def daily_counts(df: DataFrame, ts: str = "time_utc") -> DataFrame:
    """A4: events per calendar day."""
    return (df.where(F.col(ts).isNotNull())
            .groupBy(F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("nb_seismes")))


def zone_weekly(df: DataFrame, ts: str = "time_utc", zone: str = "zone",
                mode: str = "w_mon_close", with_centroid: bool = False) -> DataFrame:
    """A5 (+A6): zone x week counts, optionally with mean coordinates."""
    aggs = [F.count(F.lit(1)).alias("nb_seismes")]
    if with_centroid:
        aggs += [F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")]
    return (df.where(F.col(ts).isNotNull() & F.col(zone).isNotNull())
            .groupBy(week_label(ts, mode).alias("date"), F.col(zone)).agg(*aggs))


def circular_mean_deg(col: str):
    """Mean of angles in degrees on the circle (date-line safe, SURVEY D14)."""
    rad = F.radians(col)
    return F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad))))


def zone_centroids(df: DataFrame, zone: str = "zone", circular: bool = False,
                   both: bool = False) -> DataFrame:
    """Mean latitude/longitude per zone in one aggregate.

    ``circular=True`` averages longitude on the circle; ``both=True`` adds
    the circular mean as ``longitude_circular`` next to the plain mean.
    """
    lon = circular_mean_deg("longitude") if circular else F.avg("longitude")
    aggs = [F.avg("latitude").alias("latitude"), lon.alias("longitude")]
    if both:
        aggs.append(circular_mean_deg("longitude").alias("longitude_circular"))
    return df.groupBy(zone).agg(*aggs)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Category frequencies, descending (ties by value)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_last(col)))


def class_summary(df: DataFrame, cls: str = "mag_class_id") -> DataFrame:
    """Per-class counts and total in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(cls) == 0).alias("count_faible"),
        F.count_if(F.col(cls) == 1).alias("count_modere"),
        F.count_if(F.col(cls) == 2).alias("count_strong"),
    )


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Distinct non-NULL values (HyperLogLog++ when ``approx``)."""
    f = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return df.agg(f.alias(f"n_distinct_{col}"))


def range_bounds(df: DataFrame, col: str) -> DataFrame:
    """min/max of a column (spine bounds)."""
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def zero_periods(df: DataFrame, col: str = "nb_seismes") -> DataFrame:
    """Number of periods whose count is 0."""
    return df.agg(F.count_if(F.col(col) == 0).alias("zero_periods"))
