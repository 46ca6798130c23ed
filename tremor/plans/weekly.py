"""L1 — weekly series and forecasting features (the flagship plan).

events -> weekly rollup (A1+A3, one partial/final aggregate) -> gap-free
week spine with interpolation (J4, W14) -> lags, previous-row rolling
statistics, calendar and ratio features (W1-W7, P11-P15).

Only the rollup touches event rows; everything after it works on one row
per week (about 52 a year), so the global, ordered windows are cheap.
All window columns share one ordering, so Spark plans a single sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.scalars import cyclic, ratio1
from tremor.functions.weeks import iso_week
from tremor.operators.joins import fill_weeks
from tremor.operators.rollup import weekly_rollup
from tremor.operators.windows import _w, rolling
from tremor.session import materialize

# Lag and window sizes of the weekly feature table.
COUNT_LAGS = [1, 2, 3, 4, 8, 12, 52]
ENERGY_LAGS = [1, 2, 4]
ZONE_LAGS = [1, 2]
ROLL_MEAN = [4, 8, 12, 26]
ROLL_STD = [4, 8, 12]
ROLL_MAX = [4, 8]
ENERGY_ROLL = [4, 8]

# The 19 features the forecast model consumes, in order.
MODEL_FEATURES = [
    "nb_zones", "energy_per_seisme", "log_energy", "energy_lag_1", "energy_rolling_4",
    "mag_max", "mag_spread", "depth_mean", "lag_1", "lag_2", "lag_3",
    "rolling_mean_4", "rolling_mean_8", "rolling_mean_26", "rolling_std_8",
    "rolling_max_4", "zones_lag_1", "zones_lag_2", "week_sin",
]


def add_weekly_features(weekly: DataFrame, date: str = "date", by=None) -> DataFrame:
    """W1-W7, P11-P15 on a gap-free weekly table (one window ordering)."""
    w = _w(by, date)
    cols = {}
    for k in COUNT_LAGS:
        cols[f"lag_{k}"] = F.lag("nb_seismes", k).over(w).cast("double")
    for k in ENERGY_LAGS:
        cols[f"energy_lag_{k}"] = F.lag("energy_sum", k).over(w)
    for k in ZONE_LAGS:
        cols[f"zones_lag_{k}"] = F.lag("nb_zones", k).over(w).cast("double")
    for n in ROLL_MEAN:
        cols[f"rolling_mean_{n}"] = rolling("nb_seismes", n, "mean", by, date)
    for n in ROLL_STD:
        cols[f"rolling_std_{n}"] = rolling("nb_seismes", n, "std", by, date)
    for n in ROLL_MAX:
        cols[f"rolling_max_{n}"] = rolling("nb_seismes", n, "max", by, date).cast("double")
    for n in ENERGY_ROLL:
        cols[f"energy_rolling_{n}"] = rolling("energy_sum", n, "mean", by, date)
    woy = iso_week(date)
    cols["week_of_year"] = woy
    cols["month"] = F.month(date)
    cols["quarter"] = F.quarter(date)
    cols["year"] = F.year(date)
    cols["week_sin"], cols["week_cos"] = cyclic(woy, 52)
    cols["month_sin"], cols["month_cos"] = cyclic(F.month(date), 12)
    cols["energy_per_seisme"] = ratio1("energy_sum", "nb_seismes")
    cols["tsunami_ratio"] = ratio1("tsunami_sum", "nb_seismes")
    cols["mag_spread"] = F.col("mag_max") - F.col("mag_mean")
    cols["delta_seismes"] = (F.col("nb_seismes") - F.lag("nb_seismes", 1).over(w)).cast("double")
    cols["log_energy"] = F.log1p("energy_sum")
    return weekly.withColumns(cols)


def weekly_series(events: DataFrame, ts: str = "time_utc", mode: str = "w_mon_close",
                  exact_median=True, fill: bool = True, closed_as_of: str | None = None,
                  by=None) -> DataFrame:
    """A1+A3 (+J4): the weekly rollup, gap-filled.

    ``closed_as_of`` keeps only weeks that had ended by that time (SURVEY
    D3: the running week is partial and would be learned as if complete);
    the filter is applied to the events, so it reaches the scan.
    """
    if closed_as_of is not None:
        # last bin-end day strictly before the cutoff's day: a Monday for
        # (Tue..Mon] bins, a Sunday for Monday..Sunday bins
        day = F.to_date(F.lit(closed_as_of).cast("timestamp_ntz"))
        last_end = F.next_day(F.date_sub(day, 8), "Mon" if mode == "w_mon_close" else "Sun")
        events = events.where(F.col(ts) < F.date_add(last_end, 1).cast("timestamp_ntz"))
    weekly = weekly_rollup(events, ts=ts, mode=mode, by=by, exact_median=exact_median)
    return fill_weeks(weekly, by=by) if fill else weekly


def weekly_features(events: DataFrame, ts: str = "time_utc", mode: str = "w_mon_close",
                    exact_median=True, by=None) -> DataFrame:
    """The full weekly feature table (notebook §02 / forecast job features);
    with ``by`` (e.g. ["zone"]) one independent series per key, every window
    partitioned by it."""
    return add_weekly_features(weekly_series(events, ts, mode, exact_median, by=by), by=by)


def next_features(feat: DataFrame, date: str = "date") -> DataFrame:
    """W12 (compat): the next-week feature row built from the newest week as
    the reference does — current values shifted into next week's lags.

    Same-week measures are carried over unchanged and rolling statistics
    stay one step stale (SURVEY D8); :func:`next_features_consistent` is the
    variant that reruns the window code on an appended future row.
    """
    last = feat.orderBy(F.desc(date)).limit(1)
    nxt = F.date_add(F.col(date), 7)
    sin_w, _ = cyclic(iso_week(nxt), 52)
    return last.select(
        nxt.alias("next_date"),
        F.col("nb_zones").cast("double").alias("nb_zones"),
        "energy_per_seisme", "log_energy",
        F.col("energy_sum").alias("energy_lag_1"), "energy_rolling_4", "mag_max", "mag_spread",
        "depth_mean", F.col("nb_seismes").cast("double").alias("lag_1"),
        F.col("lag_1").alias("lag_2"), F.col("lag_2").alias("lag_3"),
        "rolling_mean_4", "rolling_mean_8", "rolling_mean_26", "rolling_std_8", "rolling_max_4",
        F.col("nb_zones").cast("double").alias("zones_lag_1"), F.col("zones_lag_1").alias("zones_lag_2"),
        sin_w.alias("week_sin"))


def next_features_consistent(weekly: DataFrame, date: str = "date") -> DataFrame:
    """W12 (consistent): append next week's spine row with unknown measures
    and run the *same* feature code, so lags and rolling windows include the
    newest week exactly as they do in training rows."""
    weekly = materialize(weekly)          # read for its last label and for the features
    last = weekly.agg(F.max(date).alias(date)).select(F.date_add(F.col(date), 7).alias(date))
    future = last.select(date, *[F.lit(None).cast(t).alias(c) for c, t in weekly.dtypes if c != date])
    feats = add_weekly_features(weekly.unionByName(future))
    return feats.orderBy(F.desc(date)).limit(1)


# Same-week measures the reference feeds to its model; in a consistent
# setup each is replaced by last week's value.
SAME_WEEK = ["nb_zones", "energy_per_seisme", "log_energy", "mag_max", "mag_spread", "depth_mean"]
CONSISTENT_FEATURES = [f"prev_{c}" if c in SAME_WEEK else c for c in MODEL_FEATURES]


def add_prev_measures(feats: DataFrame, date: str = "date", by=None) -> DataFrame:
    """``prev_<m>`` = last week's value of each same-week measure (W1 form)."""
    w = _w(by, date)
    return feats.withColumns({f"prev_{c}": F.lag(F.col(c).cast("double"), 1).over(w) for c in SAME_WEEK})


def consistent_training_rows(weekly: DataFrame, date: str = "date") -> DataFrame:
    """Training table and next-week row from the SAME code: the future label
    is appended with unknown measures before features are computed, so the
    last row is exactly what the model sees at prediction time."""
    weekly = materialize(weekly)          # read for its last label and for the features
    last = weekly.agg(F.max(date).alias(date)).select(F.date_add(F.col(date), 7).alias(date))
    future = last.select(date, *[F.lit(None).cast(t).alias(c) for c, t in weekly.dtypes if c != date])
    return add_prev_measures(add_weekly_features(weekly.unionByName(future)), date)
