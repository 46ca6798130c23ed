"""Per-series statistics for many series at once.

Series are small after the weekly rollup; ``by`` partitions the work so
thousands of series run in parallel.  SQL aggregates and window functions
carry the decomposition, the Dickey-Fuller statistic and AR(2); the two
recursions (Durbin-Levinson PACF, Holt-Winters) are folds over sorted arrays
inside the JVM (max_lag + 1 autocorrelations, a value per week).  Augmented
tests and ARMA fits are in ``operators/lagfit.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.common import attach_row
from tremor.operators.stats import acf

# Dickey-Fuller critical values, constant and no trend
# (asymptotic, MacKinnon): 1 %, 5 %, 10 %.
DF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}


def decompose(df: DataFrame, y: str = "nb_seismes", period: int = 52, order: str = "date", by=None) -> DataFrame:
    """Classical additive decomposition (re-aimed from robust STL).

    trend    = centred 2 x period moving average (NULL at the edges);
    seasonal = mean detrended value per phase, centred to sum 0;
    resid    = y - trend - seasonal.
    """
    by = list(by or [])
    w = (Window.partitionBy(*by) if by else Window).orderBy(order)
    half = period // 2
    rn = F.row_number().over(w) - 1
    win = w.rowsBetween(-half, half)
    full = F.count(y).over(win) == (2 * half + 1)
    if period % 2 == 0:
        ma = (F.sum(y).over(win) - 0.5 * (F.lag(y, half).over(w) + F.lead(y, half).over(w))) / period
    else:
        ma = F.avg(y).over(win)
    out = df.withColumn("__phase", F.pmod(rn, F.lit(period))).withColumn("trend", F.when(full, ma))
    out = out.withColumn("__detr", F.col(y) - F.col("trend"))
    phase_w = Window.partitionBy(*by, "__phase")
    series_w = Window.partitionBy(*by) if by else Window.partitionBy()
    out = out.withColumn("__pm", F.avg("__detr").over(phase_w))
    # mean over the `period` phase means (each phase counted once)
    first_of_phase = F.row_number().over(Window.partitionBy(*by, "__phase").orderBy(order)) == 1
    out = out.withColumn("__pm1", F.when(first_of_phase, F.col("__pm")))
    out = out.withColumn("seasonal", F.col("__pm") - F.avg("__pm1").over(series_w))
    out = out.withColumn("resid", F.col(y) - F.col("trend") - F.col("seasonal"))
    return out.drop("__phase", "__detr", "__pm", "__pm1")


def dickey_fuller(df: DataFrame, y: str = "nb_seismes", order: str = "date", by=None) -> DataFrame:
    """Dickey-Fuller t-statistic (constant, lag 0) per series:
    dy_t = a + b*y_{t-1}; stat = b / se(b) from regression aggregates."""
    by = list(by or [])
    w = (Window.partitionBy(*by) if by else Window).orderBy(order)
    x = F.lag(y, 1).over(w)
    d = df.select(*by, (F.col(y) - x).cast("double").alias("__dy"), x.cast("double").alias("__x"))
    g = d.groupBy(*by) if by else d.groupBy()
    agg = g.agg(F.regr_count("__dy", "__x").alias("n"), F.regr_sxx("__dy", "__x").alias("__sxx"),
                F.regr_syy("__dy", "__x").alias("__syy"), F.regr_sxy("__dy", "__x").alias("__sxy"))
    # constant or too-short series give NULL statistics instead of a failed job
    beta = F.try_divide("__sxy", "__sxx")
    sse = F.col("__syy") - F.try_divide(F.col("__sxy") * F.col("__sxy"), F.col("__sxx"))
    se = F.sqrt(F.try_divide(F.try_divide(sse, F.col("n") - 2), F.col("__sxx")))
    out = agg.withColumn("beta", beta).withColumn("df_stat", F.try_divide(beta, se))
    out = out.withColumn("stationary_5pct", F.col("df_stat") < F.lit(DF_CRITICAL["5%"]))
    return out.drop("__sxx", "__syy", "__sxy")


def ar2(df: DataFrame, y: str = "nb_seismes", order: str = "date", by=None, horizon: int = 4) -> DataFrame:
    """AR(2) with constant by least squares on centred sums (re-aimed
    from ARIMA(2,0,1)); recursive ``horizon``-step forecast with ``aggregate``."""
    by = list(by or [])
    w = (Window.partitionBy(*by) if by else Window).orderBy(order)
    d = df.select(*by, F.col(order), F.col(y).cast("double").alias("__y"),
                  F.lag(y, 1).over(w).cast("double").alias("__x1"), F.lag(y, 2).over(w).cast("double").alias("__x2"))
    last = (d.groupBy(*by) if by else d.groupBy()).agg(F.max_by("__y", order).alias("__yT"),
                                                       F.max_by("__x1", order).alias("__yT1"))
    fit = d.where(F.col("__x2").isNotNull())
    g = fit.groupBy(*by) if by else fit.groupBy()
    s = g.agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("__my"), F.avg("__x1").alias("__m1"),
              F.avg("__x2").alias("__m2"), F.covar_pop("__x1", "__x1").alias("__s11"),
              F.covar_pop("__x2", "__x2").alias("__s22"), F.covar_pop("__x1", "__x2").alias("__s12"),
              F.covar_pop("__x1", "__y").alias("__s1y"), F.covar_pop("__x2", "__y").alias("__s2y"))
    det = F.col("__s11") * F.col("__s22") - F.col("__s12") * F.col("__s12")
    # a degenerate (e.g. constant) series has det = 0: NULL coefficients
    a1 = F.try_divide(F.col("__s1y") * F.col("__s22") - F.col("__s2y") * F.col("__s12"), det)
    a2 = F.try_divide(F.col("__s2y") * F.col("__s11") - F.col("__s1y") * F.col("__s12"), det)
    s = s.withColumn("a1", a1).withColumn("a2", a2)
    s = s.withColumn("c", F.col("__my") - F.col("a1") * F.col("__m1") - F.col("a2") * F.col("__m2"))
    out = s.join(last, by, "inner") if by else attach_row(s, last)
    init = F.struct(F.col("__yT").alias("p1"), F.col("__yT1").alias("p2"),
                    F.array().cast("array<double>").alias("fc"))

    def step(acc, _):
        nxt = F.col("c") + F.col("a1") * acc["p1"] + F.col("a2") * acc["p2"]
        return F.struct(nxt.alias("p1"), acc["p1"].alias("p2"), F.concat(acc["fc"], F.array(nxt)).alias("fc"))

    fc = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step)["fc"]
    return out.select(*by, "n", "c", "a1", "a2", fc.alias("forecast"))


def durbin_levinson(r: str, max_lag: int):
    """Partial autocorrelations 0..max_lag of the autocorrelations in the array
    column ``r``: a fold over the lags whose state is (phi, v, values)."""

    def step(now, k):
        terms = F.transform(now["phi"], lambda x, j: x * F.element_at(r, k - j))            # phi_j r_{k-j}, j from 1
        partial = F.try_divide(F.element_at(r, k + 1) - F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), now["v"])
        turned = F.transform(now["phi"], lambda x, j: x - partial * F.element_at(now["phi"], k - 1 - j))
        return F.struct(F.concat(turned, F.array(partial)).alias("phi"), (now["v"] * (1 - partial * partial)).alias("v"),
                        F.concat(now["values"], F.array(partial)).alias("values"))

    start = F.struct(F.array().cast("array<double>").alias("phi"), F.lit(1.0).alias("v"), F.array(F.lit(1.0)).alias("values"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), start, step)["values"]


def pacf(df: DataFrame, y: str = "nb_seismes", max_lag: int = 60, order: str = "date", by=None) -> DataFrame:
    """Partial autocorrelation per series: the autocorrelations (A20) as
    a sorted array, then the Durbin-Levinson fold.  NULL from a lag on where
    the remaining variance is 0."""
    by = list(by or [])
    rows = acf(df, y, max_lag, order, by)
    pairs = F.sort_array(F.collect_list(F.struct("lag", F.struct("acf").alias("v"))))
    series = rows.groupBy(*by).agg(F.transform(pairs, lambda s: s["v"]["acf"]).alias("__r"))
    return series.select(*by, F.posexplode(durbin_levinson("__r", max_lag)).alias("lag", "pacf"))


# The smoothing grid searched when ``optimize=True``.
HW_GRID = {"alpha": [0.1, 0.2, 0.3, 0.5, 0.7], "beta": [0.01, 0.05, 0.1], "gamma": [0.05, 0.1, 0.2, 0.4]}


def holt_winters(df: DataFrame, y: str = "nb_seismes", period: int = 52, order: str = "date", by=None,
                 alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2, horizon: int = 4,
                 optimize: bool = False) -> DataFrame:
    """Additive Holt-Winters per series, a fold over the series as a
    sorted array; the state is (level, trend, season, error so far), the
    season turning by one place a step.

    Fixed smoothing parameters, or with ``optimize=True`` the grid point with
    the least in-sample one-step squared error (a coarse stand-in for the
    reference's optimiser): each series is folded once per grid point, side by
    side.  Series shorter than two periods have NULL sse and an empty
    forecast; a NULL value counts as 0."""
    by = list(by or [])
    points = ([(a, b, g) for a in HW_GRID["alpha"] for b in HW_GRID["beta"] for g in HW_GRID["gamma"]] if optimize else [(alpha, beta, gamma)])
    grid = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("alpha", "beta", "gamma"), p)]) for p in points]))
    value = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    series = (df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"]).alias("__x"))
              .select(*by, "__x", F.size("__x").alias("n"), grid.alias("__p")).select(*by, "__x", "n", "__p.*"))

    def mean(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / period

    x, a, b, g = F.col("__x"), F.col("alpha"), F.col("beta"), F.col("gamma")
    first = mean(F.slice(x, 1, period))
    start = F.struct(first.alias("level"), ((mean(F.slice(x, period + 1, period)) - first) / period).alias("trend"),
                     F.transform(F.slice(x, 1, period), lambda v: v - F.col("__first")).alias("season"), F.lit(0.0).alias("sse"))

    def step(now, v):
        s = F.element_at(now["season"], 1)
        error = v - (now["level"] + now["trend"] + s)
        level = a * (v - s) + (1 - a) * (now["level"] + now["trend"])
        return F.struct(level.alias("level"), (b * (level - now["level"]) + (1 - b) * now["trend"]).alias("trend"),
                        F.concat(F.slice(now["season"], 2, period), F.array(g * (v - level) + (1 - g) * s)).alias("season"),
                        (now["sse"] + error * error).alias("sse"))

    folded = series.withColumn("__first", first).withColumn("__end", F.when(F.col("n") >= 2 * period, F.aggregate(x, start, step)))
    end = F.col("__end")
    forecast = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: end["level"] + h * end["trend"] + F.element_at(end["season"], (h - 1) % period + 1))
    scored = folded.select(*by, "n", "alpha", "beta", "gamma", end["sse"].alias("sse"),
                           F.when(end.isNull(), F.array().cast("array<double>")).otherwise(forecast).alias("forecast"))
    best = F.min_by(F.struct("n", "alpha", "beta", "gamma", "sse", "forecast"), F.struct("sse", "alpha", "beta", "gamma"))
    return scored.groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*")
