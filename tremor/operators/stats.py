"""Statistical aggregates.

Each is one aggregate (partial + final) or an aggregate over a rollup
output.  Bounds computed by a global aggregate are a single row and are
attached as one scalar subquery (evaluated once, size enforced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.common import attach_row


def _attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (one scalar subquery)."""
    return attach_row(df, one_row)


def quartile_fences(df: DataFrame, col: str, k: float = 3.0, exact: bool = True) -> DataFrame:
    """Q1, Q3 and the k*IQR fences as one row."""
    q = (F.percentile(col, F.array(F.lit(0.25), F.lit(0.75))) if exact
         else F.percentile_approx(col, [0.25, 0.75], 10000))
    return (df.agg(q.alias("__q"))
            .select(F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("q3"))
            .withColumn("lower", F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1")))
            .withColumn("upper", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))))


def iqr_outliers(df: DataFrame, col: str, k: float = 3.0, exact: bool = True) -> DataFrame:
    """A9 + P17: flag rows outside the fences and add a winsorised copy."""
    from tremor.functions.scalars import winsorise
    out = _attach(df, quartile_fences(df, col, k, exact))
    return (out.withColumn("is_outlier", (F.col(col) < F.col("lower")) | (F.col(col) > F.col("upper")))
            .withColumn(f"{col}_clean", winsorise(col, F.col("lower"), F.col("upper"))))


def tier_bounds(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """A10: 33rd and 66th percentiles with linear interpolation (one row)."""
    q = (F.percentile(col, F.array(F.lit(0.33), F.lit(0.66))) if exact
         else F.percentile_approx(col, [0.33, 0.66], 10000))
    return df.agg(q.alias("__q")).select(F.col("__q")[0].alias("p33"), F.col("__q")[1].alias("p66"))


def _stack(row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return row.selectExpr(f"stack({len(names)}, {pairs}) AS ({key}, {value})")


def pearson(a: str, b: str) -> Column:
    """Pearson correlation over the rows that have both columns, from their
    moments: NaN where either is constant (``F.corr`` divides by zero there and
    fails the job), NULL without such rows."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.when(F.count_if(both) > 0, F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(float("nan"))))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, long form (a, b, corr);
    NaN with a constant column."""
    names, aggs = [], []
    for a in cols:
        for b in cols:
            n = f"{a}__{b}"
            names.append(n)
            aggs.append((F.lit(1.0) if a == b else pearson(a, b)).alias(n))
    long = _stack(df.agg(*aggs), names, "pair", "corr")
    parts = F.split("pair", "__")
    return long.select(parts[0].alias("feature_a"), parts[1].alias("feature_b"), "corr")


def corr_target(df: DataFrame, feats: list[str], y: str, top: int | None = None) -> DataFrame:
    """Correlation of each feature with the target, descending; a constant
    column has NaN, which sorts first."""
    long = _stack(df.agg(*[pearson(f, y).alias(f) for f in feats]), feats, "feature", "corr")
    out = long.orderBy(F.desc("corr"), F.asc("feature"))
    return out.limit(top) if top else out


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percent per column (only > 0), descending."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = row.selectExpr("__rows", f"stack({len(cols)}, {pairs}) AS (column_name, missing_count)")
    return (long.where(F.col("missing_count") > 0)
            .select("column_name", "missing_count",
                    F.round(F.col("missing_count") * 100.0 / F.col("__rows"), 2).alias("missing_pct"))
            .orderBy(F.desc("missing_count"), F.asc("column_name")))


def summary(df: DataFrame, date: str, value: str) -> DataFrame:
    """Rows, date range and min/max/mean of a value."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("date_min"),
                  F.max(date).alias("date_max"), F.min(value).alias("value_min"),
                  F.max(value).alias("value_max"), F.avg(value).alias("value_mean"))


def zscore_last(df: DataFrame, n: int = 8, value: str = "nb_seismes", date: str = "date") -> DataFrame:
    """Mean and sample sd of the last ``n`` periods and the z-score of
    the newest one (0 when sd is 0)."""
    last = df.orderBy(F.desc(date)).limit(n)
    agg = last.agg(F.avg(value).alias("mean_n"), F.stddev_samp(value).alias("std_n"),
                   F.max_by(F.col(value), F.col(date)).alias("current"))
    z = F.when(F.col("std_n") > 0, (F.col("current") - F.col("mean_n")) / F.col("std_n")).otherwise(F.lit(0.0))
    return agg.withColumn("z_score", z)


def acf(df: DataFrame, y: str, max_lag: int = 60, order: str = "date", by=None) -> DataFrame:
    """Autocorrelation for lags 0..max_lag (statsmodels' non-adjusted form);
    NULL for a constant series (zero variance) instead of a failed job.

    Lagged values come from window ``lag`` over the (small) series; the sums
    are one aggregate per series.
    """
    by = list(by or [])
    wmean = Window.partitionBy(*by) if by else Window.partitionBy()
    w = (Window.partitionBy(*by) if by else Window).orderBy(order)
    centred = df.withColumn("__d", F.col(y) - F.avg(y).over(wmean))
    lagged = centred.select(*by, "__d", *[F.lag("__d", k).over(w).alias(f"__l{k}") for k in range(max_lag + 1)])
    sums = lagged.groupBy(*by).agg(F.sum(F.col("__d") * F.col("__d")).alias("__den"),
                                   *[F.sum(F.col("__d") * F.col(f"__l{k}")).alias(f"__n{k}")
                                     for k in range(max_lag + 1)])
    pairs = ", ".join(f"{k}, `__n{k}`" for k in range(max_lag + 1))
    return sums.selectExpr(*by, "__den", f"stack({max_lag + 1}, {pairs}) AS (lag, __num)") \
        .select(*by, F.col("lag").cast("int").alias("lag"), F.try_divide("__num", "__den").alias("acf"))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by=None) -> DataFrame:
    """MAE, RMSE, R², MAPE with a +1 denominator (per model)."""
    by = list(by or [])
    e = F.col(y) - F.col(yhat)
    g = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    g = g.groupBy(*by) if by else g.groupBy()
    res = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
                F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__sse"),
                (F.count(F.lit(1)) * F.var_pop(y)).alias("__sst"),
                (F.avg(F.abs(F.try_divide(e, F.col(y) + 1))) * 100).alias("mape"))
    # a constant target has no variance to explain: R² is NULL, not an error
    return res.withColumn("r2", F.lit(1.0) - F.try_divide("__sse", "__sst")).drop("__sse", "__sst")


def coverage(df: DataFrame, y: str = "y", lo: str = "lo", hi: str = "hi", by=None) -> DataFrame:
    """Percent of observations inside [lo, hi]."""
    by = list(by or [])
    inside = F.when(F.col(y).between(F.col(lo), F.col(hi)), 1.0).otherwise(0.0)
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg((F.avg(inside) * 100).alias("coverage_pct"))


def cv_summary(df: DataFrame, metric: str = "mae") -> DataFrame:
    """Fold mean and population sd (np.std) of a per-fold metric."""
    return df.agg(F.avg(metric).alias(f"{metric}_mean"), F.stddev_pop(metric).alias(f"{metric}_std"),
                  F.count(F.lit(1)).alias("folds"))


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram; the maximum goes into the last bin."""
    bounds = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    b = F.least(F.floor(F.lit(bins) * (F.col(col) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))) + 1,
                F.lit(bins))
    b = F.when(F.col("__lo") == F.col("__hi"), F.lit(1)).otherwise(b)
    return (_attach(df.where(F.col(col).isNotNull()), bounds)
            .groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"),
                                                     F.min("__lo").alias("lo"), F.min("__hi").alias("hi")))


def five_numbers(df: DataFrame, col: str) -> DataFrame:
    """Min, Q1, median, Q3, max (box-plot numbers)."""
    q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.min(col).alias("min"), q.alias("__q"), F.max(col).alias("max")).select(
        "min", F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"),
        F.col("__q")[2].alias("q3"), "max")


def class_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Accuracy and macro-F1 from confusion counts (one row).

    Confusion counts are one small aggregate (classes x classes); per-class
    precision/recall/F1 are then aggregates over that table.
    """
    conf = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    tp = conf.where(F.col("y") == F.col("yhat")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    actual = conf.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("n_true"))
    pred = conf.groupBy(F.col("yhat").alias("c")).agg(F.sum("n").alias("n_pred"))
    per = actual.join(pred, "c", "full").join(tp, "c", "left").fillna(0, subset=["tp", "n_true", "n_pred"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_true")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return per.agg((F.sum("tp") / F.sum("n_true")).alias("accuracy"), F.avg(f1).alias("f1_macro"),
                   F.sum("n_true").alias("n"))
