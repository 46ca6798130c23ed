"""Joins, spines and grids.

Gap filling never re-reads the events: each rollup row emits itself plus
the missing labels up to the next row of its series (``lead`` over the
rollup, then ``explode(sequence(...))``).  The rows generated are exactly
the output rows, the rollup is computed once, and no join against a
separate spine is planned.  The grid/spine size grows with time (weeks x
zones), not with event volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.common import attach_row
from tremor.operators.windows import interpolate
from tremor.session import materialize


def _fill_forward(df: DataFrame, date: str, upto, keep_cols, step_days: int = 7,
                  start=None) -> DataFrame:
    """Each row emits labels from ``start`` (default: its own date) to ``upto``;
    generated rows keep ``keep_cols`` and get NULL elsewhere."""
    step = F.expr(f"INTERVAL {step_days} DAYS")
    begin = start if start is not None else F.col(date)
    cols = [c for c in df.columns if c not in (date, "__upto", "__begin")]
    gen = (df.withColumn("__upto", upto).withColumn("__begin", begin)
           .select(*[F.col(c) for c in df.columns], F.explode(F.sequence("__begin", "__upto", step)).alias("__d")))
    own = F.col("__d") == F.col(date)
    return gen.select(F.col("__d").alias(date),
                      *[F.col(c) if c in keep_cols else F.when(own, F.col(c)).alias(c) for c in cols])


def fill_weeks(weekly: DataFrame, date: str = "date", zero_cols=("nb_seismes", "tsunami_sum",
               "nb_zones", "energy_sum"), interp_cols=("mag_max", "mag_mean", "mag_median",
               "depth_mean"), step_days: int = 7, by=None) -> DataFrame:
    """Gap-free weekly series from the first to the last label (of each
    series when ``by`` names the series keys).

    Missing weeks get 0 for counts/sums and linear interpolation for the
    continuous columns (notebook gap fill, then W14).
    """
    by = list(by or [])
    w = (Window.partitionBy(*by) if by else Window).orderBy(date)
    upto = F.coalesce(F.date_sub(F.lead(date).over(w), step_days), F.col(date))
    full = _fill_forward(weekly, date, upto, keep_cols=tuple(by), step_days=step_days)
    full = full.fillna(0, subset=[c for c in zero_cols if c in weekly.columns])
    present = [c for c in interp_cols if c in weekly.columns]
    return interpolate(full, present, order=date, by=by or None) if present else full


def dense_grid(df: DataFrame, date: str = "date", zone: str = "zone",
               value: str = "nb_seismes", step_days: int = 7) -> DataFrame:
    """Every (week, zone) cell between the global first and last week;
    absent cells count 0.

    The global bounds are one aggregate over the rollup, attached as a scalar
    subquery (the rollup is written once); each zone row emits the missing weeks up to its zone's next row (the last row up
    to the global end, the first row also back to the global start).  No
    cartesian product and no second pass over the events.
    """
    zw = Window.partitionBy(zone).orderBy(date)
    df = materialize(df.select(date, zone, value))
    base = (attach_row(df, df.agg(F.min(date).alias("__lo"), F.max(date).alias("__hi")))
            .withColumn("__next", F.lead(date).over(zw))
            .withColumn("__first", F.row_number().over(zw) == 1))
    upto = F.coalesce(F.date_sub("__next", step_days), F.col("__hi"))
    start = F.when(F.col("__first"), F.col("__lo")).otherwise(F.col(date))
    base = base.withColumn("__start", start).drop("__first")
    out = _fill_forward(base, date, upto, keep_cols=(zone,), step_days=step_days, start=F.col("__start"))
    return out.select(date, zone, F.coalesce(F.col(value), F.lit(0)).alias(value))


def zone_map(pred: DataFrame, centroids: DataFrame, zone: str = "zone") -> DataFrame:
    """Attach zone centres to predictions (left join on zone)."""
    return pred.join(centroids, zone, "left")


def join_left(a: DataFrame, b: DataFrame, key: str = "date") -> DataFrame:
    """Left equi join on a shared grain."""
    return a.join(b, key, "left")


def join_inner(a: DataFrame, b: DataFrame, key: str = "zone") -> DataFrame:
    """Inner equi join (AQE chooses broadcast when a side is small at run time)."""
    return a.join(b, key, "inner")


def compare_forecast(weekly: DataFrame, forecast: DataFrame, date: str = "date") -> DataFrame:
    """Forecast document vs the latest week: difference, %, interval width.

    ``forecast`` has columns central, low, high, next_week_start.  The latest
    week is found with ``max_by`` (one aggregate, one row) and attached to
    the forecast row as a scalar subquery.
    """
    from tremor.functions.bands import direction
    from tremor.functions.scalars import safe_pct

    last = weekly.agg(F.max_by(F.col("nb_seismes"), F.col(date)).alias("current"),
                      F.max(date).alias("current_week"))
    out = attach_row(forecast, last)
    diff = F.col("central") - F.col("current")
    return out.select(
        "next_week_start", "current_week",
        F.col("current").cast("bigint").alias("current"),
        F.col("central").cast("bigint").alias("central"),
        diff.cast("bigint").alias("diff"),
        F.round(safe_pct(diff, F.col("current")), 6).alias("diff_pct"),
        (F.col("high") - F.col("low")).cast("bigint").alias("interval_width"),
        direction(F.col("central"), F.col("current")).alias("direction"),
    )
