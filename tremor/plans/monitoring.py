"""L4 — weekly monitoring: week-on-week change, anomaly z-score, forecast
comparison and bar lengths (W13, A19, J9, P21-P24, P33).

Everything here works on the weekly rollup (one row per week); the "last
n weeks" are taken with ``orderBy().limit()`` (TakeOrderedAndProject), so
no step ever sorts event rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.bands import anomaly_band, trend_band
from tremor.functions.scalars import fmt_change, safe_pct
from tremor.operators.stats import zscore_last


def last_n(weekly: DataFrame, n: int = 8, date: str = "date") -> DataFrame:
    return weekly.orderBy(F.desc(date)).limit(n)


def week_on_week(weekly: DataFrame, n: int = 8, date: str = "date", value: str = "nb_seismes") -> DataFrame:
    """Change vs the previous week inside the last ``n`` weeks.

    The first of the n rows has no previous row (the report prints a dash),
    so diff/pct/trend are NULL there; the newest row is marked current.
    """
    tail = last_n(weekly, n, date).select(date, value)
    w = Window.orderBy(date)
    prev = F.lag(value, 1).over(w)
    diff = F.col(value) - prev
    out = tail.select(
        date, F.col(value).cast("bigint").alias(value), diff.cast("bigint").alias("diff"),
        F.when(prev.isNotNull(), safe_pct(diff, prev)).alias("pct"),
        F.when(prev.isNotNull(), trend_band(diff)).alias("trend"),
        F.when(prev.isNotNull(), fmt_change(diff, safe_pct(diff, prev))).alias("change_text"),
        (F.row_number().over(Window.orderBy(F.desc(date))) == 1).alias("is_current"))
    return out


def anomaly(weekly: DataFrame, n: int = 8, date: str = "date", value: str = "nb_seismes") -> DataFrame:
    """A19 + P23: z-score of the newest week against the last ``n`` and its band."""
    z = zscore_last(weekly, n, value, date)
    return z.withColumn("anomaly", anomaly_band(F.col("z_score")))


def bar_lengths(weekly: DataFrame, forecast_central, n: int = 8, date: str = "date",
                value: str = "nb_seismes", width: int = 40) -> DataFrame:
    """int((v - min) / (max - min + 1) * width) over last n weeks + the forecast.

    ``forecast_central`` is a one-row DataFrame with columns (date, central).
    """
    tail = last_n(weekly, n, date).select(date, F.col(value).cast("bigint").alias("v"),
                                          F.lit(False).alias("is_forecast"))
    pred = forecast_central.select(F.col(date), F.col("central").cast("bigint").alias("v"),
                                   F.lit(True).alias("is_forecast"))
    both = tail.unionByName(pred)
    allw = Window.partitionBy()
    lo, hi = F.min("v").over(allw), F.max("v").over(allw)
    return both.withColumn("bar", ((F.col("v") - lo) / (hi - lo + 1) * width).cast("int"))
