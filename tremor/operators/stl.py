"""Robust seasonal-trend decomposition by local regression (STL).

Each series is smoothed in rounds (Cleveland et al. 1990): the values of a
phase (the same week of each year) by local lines, less their low-pass part,
give the season; the rest, smoothed by wide local lines, gives the trend.
After some rounds points far from both get small bisquare weights and the
rounds begin again, so an outlier stays in the remainder.

A task holds one series as an array of its values (a value a week); Spark
deals the series.  Local lines weigh the nearest points by the tricube of
their distance times their robustness weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INNER, OUTER = 2, 15            # rounds, and times that the weights are renewed
SEASON_WIDTH = 7                # points of a phase in a local line


def odd_from(x: float) -> int:
    """The least odd whole number not below x."""
    n = int(np.ceil(x))
    return n + 1 - n % 2


def local_lines(y: np.ndarray, width: int, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at the places ``at`` (in units of the index of y) of lines fitted
    to the ``width`` nearest points; fewer points than that widen the kernel."""
    n = len(y)
    reach = min(width, n)
    first = np.clip(np.round(at).astype(int) - (reach - 1) // 2, 0, n - reach)
    x = first[:, None] + np.arange(reach)
    gap = np.abs(x - at[:, None])
    far = np.maximum(gap[:, 0], gap[:, -1]) + max(0, (width - n) // 2)
    far = np.maximum(far, 1e-12)[:, None]
    kernel = np.where(gap <= 0.001 * far, 1.0, np.where(gap <= 0.999 * far, (1 - (gap / far) ** 3) ** 3, 0.0)) * weight[x]
    total = kernel.sum(axis=1, keepdims=True)
    kernel = np.where(total > 0, kernel / np.where(total > 0, total, 1), 0)
    middle = (kernel * x).sum(axis=1)
    spread = (kernel * (x - middle[:, None]) ** 2).sum(axis=1)
    level = (kernel * y[x]).sum(axis=1)
    slope = (kernel * (x - middle[:, None]) * y[x]).sum(axis=1)
    line = spread > (0.001 * (n - 1)) ** 2                  # else the points stand in one place: their mean
    value = level + np.where(line, (at - middle) * slope / np.where(line, spread, 1), 0)
    return np.where(total[:, 0] > 0, value, np.nan)


def _mean_of(y: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(y, np.ones(width) / width, "valid")


def seasonal_trend(y: np.ndarray, period: int, robust: bool = True, season_width: int = SEASON_WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(season, trend, robustness weights) of one series of two periods or more."""
    n = len(y)
    trend_width = odd_from(1.5 * period / (1 - 1.5 / season_width))
    low_width = odd_from(period + 1)
    trend, weight = np.zeros(n), np.ones(n)
    places = np.arange(n, dtype=float)
    for renewed in range(OUTER if robust else 1):
        for _ in range(INNER):
            rest, cycle = y - trend, np.empty(n + 2 * period)
            for phase in range(period):
                own = np.arange(phase, n, period)
                ends = np.arange(-1, len(own) + 1, dtype=float)         # one place before and after each phase
                found = local_lines(rest[own], season_width, weight[own], ends)
                held = np.concatenate([[rest[own][0]], rest[own], [rest[own][-1]]])
                cycle[phase::period][:len(ends)] = np.where(np.isnan(found), held, found)
            low = _mean_of(_mean_of(_mean_of(cycle, period), period), 3)
            season = cycle[period:period + n] - local_lines(low, low_width, np.ones(n), places)
            found = local_lines(y - season, trend_width, weight, places)
            trend = np.where(np.isnan(found), y - season, found)
        gap = np.abs(y - season - trend)
        scale = 6 * np.median(gap)
        if not robust or scale <= 0 or renewed == OUTER - 1:
            break
        weight = np.where(gap <= 0.001 * scale, 1.0, np.where(gap <= 0.999 * scale, (1 - np.minimum(1, gap / scale) ** 2) ** 2, 0.0))
    return season, trend, weight


def robust_decompose(df: DataFrame, y: str = "nb_seismes", period: int = 52, order: str = "date", by=None, robust: bool = True) -> DataFrame:
    """``by``, ``order``, y, seasonal, trend, resid, weight, one row per
    input row.  A missing value counts as 0, as the gap-filled series has it;
    a series shorter than two periods has NULL parts."""
    by = list(by or [])
    keys = by or ["__one"]
    rows = (df if by else df.withColumn("__one", F.lit(0))).select(*keys, order, F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias(y))
    parts = ["seasonal", "trend", "resid", "weight"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        values = table.column(y).to_numpy()
        if len(values) >= 2 * period:
            season, trend, weight = seasonal_trend(values, period, robust)
            found = [season, trend, values - season - trend, weight]
        else:
            found = [np.full(len(values), None)] * 4
        for name, column in zip(parts, found):
            table = table.append_column(name, pa.array(column, pa.float64()))
        return table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + ", ".join(f"{p} double" for p in parts)
    out = rows.groupBy(*keys).applyInArrow(run, schema)
    return out if by else out.drop("__one")
