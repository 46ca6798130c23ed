"""Window operators over (possibly partitioned) series.

Lags are *row* offsets, valid only on a gap-free series — run
:func:`tremor.operators.joins.fill_weeks` first.  Every operator takes a
``by`` list: a window without it plans ``Exchange SinglePartition``, which
is acceptable only after a rollup (about 52 rows a year per series).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by, order):
    w = Window.partitionBy(*by) if by else Window
    orders = [order] if isinstance(order, str) else list(order)
    return w.orderBy(*orders)


def add_lags(df: DataFrame, col: str, lags, by=None, order: str = "date",
             prefix: str | None = None) -> DataFrame:
    """``{prefix}{k}`` = value k rows earlier within the series."""
    w = _w(by, order)
    p = prefix if prefix is not None else f"{col}_lag_"
    return df.withColumns({f"{p}{k}": F.lag(col, k).over(w) for k in lags})


def rolling(col: str, w_size: int, fn: str, by=None, order: str = "date") -> Column:
    """Statistic over the *previous* ``w_size`` rows (shift 1 then
    rolling); NULL until all ``w_size`` values exist (pandas min_periods)."""
    frame = _w(by, order).rowsBetween(-w_size, -1)
    agg = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min,
           "sum": F.sum}[fn]
    return F.when(F.count(col).over(frame) == w_size, agg(col).over(frame))


def add_rolling(df: DataFrame, col: str, windows, fn: str = "mean", by=None,
                order: str = "date", prefix: str | None = None) -> DataFrame:
    p = prefix if prefix is not None else f"{col}_rolling_{fn}_"
    return df.withColumns({f"{p}{w}": rolling(col, w, fn, by, order) for w in windows})


def add_diff(df: DataFrame, col: str, name: str | None = None, by=None,
             order: str = "date") -> DataFrame:
    """First difference."""
    return df.withColumn(name or f"delta_{col}", F.col(col) - F.lag(col, 1).over(_w(by, order)))


def interpolate(df: DataFrame, cols, order: str = "date", by=None) -> DataFrame:
    """Linear interpolation over row positions.

    Leading NULLs stay NULL, trailing NULLs carry the last value (pandas
    ``interpolate(method='linear')`` edge rules).
    """
    w = _w(by, order)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    # the next value is the last one seen in descending order: a running frame
    # (linear), where one that reaches forward from each row is quadratic
    down = (Window.partitionBy(*([by] if isinstance(by, str) else by)) if by else Window).orderBy(F.desc("__rn"))
    after = down.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__rn", F.row_number().over(w))
    for c in cols:
        prev_v = F.last(c, ignorenulls=True).over(before)
        prev_i = F.last(F.when(F.col(c).isNotNull(), F.col("__rn")), ignorenulls=True).over(before)
        next_v = F.last(c, ignorenulls=True).over(after)
        next_i = F.last(F.when(F.col(c).isNotNull(), F.col("__rn")), ignorenulls=True).over(after)
        filled = F.when(next_v.isNull(), prev_v).otherwise(
            prev_v + (next_v - prev_v) * (F.col("__rn") - prev_i) / (next_i - prev_i))
        out = out.withColumn(c, F.coalesce(F.col(c), filled))
    return out.drop("__rn")


def latest_per(df: DataFrame, key: str, order: str = "date") -> DataFrame:
    """Newest row per key (``max_by`` on a struct: one partial+final
    aggregate, no per-key sort)."""
    others = [c for c in df.columns if c != key]
    packed = F.max_by(F.struct(*others), F.col(order)).alias("__r")
    return df.groupBy(key).agg(packed).select(key, "__r.*")


def tail(df: DataFrame, n: int, order: str = "date") -> DataFrame:
    """Last ``n`` rows by ``order`` (TakeOrderedAndProject), re-sorted ascending."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def holdout_last(df: DataFrame, n: int, order: str = "date", by=None) -> DataFrame:
    """Flag the last ``n`` rows (per series) as test."""
    w = _w(by, [F.desc(order)])
    return df.withColumn("is_test", F.row_number().over(w) <= n)


def holdout_frac(df: DataFrame, frac: float = 0.8, order: str = "date") -> DataFrame:
    """Positional split — the first ``frac`` of rows by ``order`` train.

    ``percent_rank`` would also work; a row number against the total keeps
    the pandas ``int(len*frac)`` cut exactly.
    """
    w = _w(None, order)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    rn = F.row_number().over(w)
    return df.withColumn("is_test", rn > F.floor(total * F.lit(frac)))


def ts_folds(df: DataFrame, n_splits: int = 5, order: str = "date") -> DataFrame:
    """Expanding time-series folds (scikit-learn TimeSeriesSplit bounds).

    Each row gets, per fold, role 'train' (before the fold's test block) or
    'val' (inside it); rows after the block are not emitted for that fold.
    Folds come from ``explode(sequence(1, n_splits))`` on the row itself, so
    no join is planned and each row is emitted at most ``n_splits`` times.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy())
    numbered = (df.withColumn("__rn", F.row_number().over(_w(None, order)) - 1)
                .withColumn("__n", n)
                .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits)))))
    test_size = F.floor(F.col("__n") / F.lit(n_splits + 1))
    start = F.col("__n") - (F.lit(n_splits) - F.col("fold") + 1) * test_size
    return (numbered.where(F.col("__rn") < start + test_size)
            .withColumn("role", F.when(F.col("__rn") < start, "train").otherwise("val"))
            .drop("__rn", "__n"))


def naive(df: DataFrame, col: str = "nb_seismes", order: str = "date", by=None) -> DataFrame:
    """naïve baseline, prediction = previous value."""
    return df.withColumn("yhat", F.lag(col, 1).over(_w(by, order)).cast("double"))


def persist_zone(df: DataFrame, zone: str = "zone", order: str = "date",
                 value: str = "nb_seismes") -> DataFrame:
    """Persistence forecast per zone — latest count is the prediction."""
    last = latest_per(df, zone, order)
    return last.withColumn("pred_seismes", F.col(value).cast("int"))
