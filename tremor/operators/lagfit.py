"""Lag regressions of many series from cross-product matrices.

A regression needs no rows, only the sums of products of its columns.  They
are one aggregate per series (combined map-side, so a long series is not
collected); the normal equations are then solved per series inside the JVM by
the sweep operator on the matrix as an array column.

Sweeping column after column solves every nested model on the way: after the
first m columns the last column holds the coefficients of the model with these
m columns, the corner its residual sum of squares and the diagonal of the
swept block the inverse that standard errors need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Finite-sample critical values of the unit-root test with a
# constant (MacKinnon 2010): value = b0 + b1/n + b2/n^2 + b3/n^3.
MACKINNON = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
MOST_LAGS = 24


def cross_products(rows: DataFrame, columns: list[str], by: list[str], where: Column | None = None) -> DataFrame:
    """``by`` and ``m``, the symmetric matrix of sums of products of the
    columns over the rows that meet ``where`` (a NULL counts as 0), and ``n``,
    their number; a series without such rows has zeros."""
    where = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    values = rows.select(*by, where.alias("__w"), *[
        F.when(where, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0).alias(f"__z{i}") for i, c in enumerate(columns)])
    sums = [F.sum(F.col(f"__z{i}") * F.col(f"__z{j}")).alias(f"__{i}_{j}") for i in range(len(columns)) for j in range(i + 1)]
    found = values.groupBy(*by).agg(F.count_if("__w").alias("n"), *sums)
    matrix = F.array(*[F.array(*[F.col(f"__{max(i, j)}_{min(i, j)}") for j in range(len(columns))]) for i in range(len(columns))])
    return found.select(*by, "n", matrix.alias("m"))


def sweep(m: Column, k: Column) -> Column:
    """The matrix with column ``k`` (from 0) exchanged; NULL entries where the
    pivot is 0 (columns that depend on each other)."""
    pivot = F.element_at(m, k + 1)
    d = F.element_at(pivot, k + 1)

    def row(r: Column, i: Column) -> Column:
        here = F.element_at(r, k + 1)
        changed = F.transform(r, lambda x, j: F.when(j == k, -F.try_divide(here, d))
                              .otherwise(x - F.try_divide(here * F.element_at(pivot, j + 1), d)))
        exchanged = F.transform(r, lambda x, j: F.when(j == k, F.try_divide(F.lit(1.0), d)).otherwise(F.try_divide(x, d)))
        return F.when(i == k, exchanged).otherwise(changed)

    return F.transform(m, row)


def swept(m: Column, count: Column) -> Column:
    """The matrix after sweeping its first ``count`` columns."""
    return F.aggregate(F.sequence(F.lit(0), count - 1), m, lambda now, k: sweep(now, k))


def _entry(m: Column, i: Column, j: Column) -> Column:
    return F.element_at(F.element_at(m, i + 1), j + 1)


def _by(df: DataFrame, by) -> tuple[DataFrame, list[str], bool]:
    by = list(by or [])
    return (df, by, False) if by else (df.withColumn("__one", F.lit(0)), ["__one"], True)


def augmented_dickey_fuller(df: DataFrame, y: str = "nb_seismes", order: str = "date", by=None, most_lags: int = MOST_LAGS) -> DataFrame:
    """The augmented test with a constant, its lags chosen by AIC.

    dy_t = c + b y_{t-1} + sum_i g_i dy_{t-i}.  Lag counts from 0 to
    ceil(12 (n / 100)^(1/4)) (at most n // 2 - 2, and ``most_lags``) are
    compared on the rows that all of them have, by one chain of sweeps; the
    statistic b / se(b) comes from the chosen count on all rows it has.  Rows:
    ``by``, n (of the last regression), used_lag, adf_stat, crit_5pct,
    stationary_5pct.  Constant or too short series have NULL statistics.
    """
    df, keys, whole = _by(df, by)
    rows = df.select(*keys, F.col(order).alias("__o"), F.col(y).cast("double").alias("__y"))
    w = Window.partitionBy(*keys).orderBy("__o")
    rows = rows.withColumn("__x", F.lag("__y", 1).over(w))
    rows = rows.withColumn("__dy", F.col("__y") - F.col("__x"))
    lags = [f"__d{i}" for i in range(1, most_lags + 1)]
    rows = rows.withColumns({f"__d{i}": F.lag("__dy", i).over(w) for i in range(1, most_lags + 1)} | {
        "__rn": F.row_number().over(w), "__len": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "__c": F.lit(1.0)})
    limit = F.greatest(F.least(F.ceil(12 * F.pow(F.col("__len") / 100, F.lit(0.25))), F.floor(F.col("__len") / 2) - 2, F.lit(most_lags)), F.lit(0)).cast("int")
    rows = rows.withColumn("__limit", limit)
    columns = ["__c", "__x", *lags, "__dy"]
    corner = len(columns) - 1

    def chain(limit: Column) -> Column:
        begun = F.col("__begun")
        first = F.struct(begun.alias("m"), F.array(_entry(begun, F.lit(corner), F.lit(corner))).alias("sse"))

        def step(now: Column, k: Column) -> Column:
            after = sweep(now["m"], k + 1)
            return F.struct(after.alias("m"), F.concat(now["sse"], F.array(_entry(after, F.lit(corner), F.lit(corner)))).alias("sse"))

        return F.when(limit > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(limit, F.lit(1))), first, step)["sse"]).otherwise(first["sse"])

    common = cross_products(rows, columns, [*keys, "__limit"], F.col("__rn") > F.col("__limit") + 1)
    sse = common.withColumn("__begun", swept(F.col("m"), F.lit(2))).withColumn("__sse", chain(F.col("__limit")))
    scored = F.transform("__sse", lambda s, p: F.struct((F.col("n") * F.log(F.when(s > 0, s)) + 2 * (p + 2)).alias("aic"), p.alias("p")))
    best = sse.select(*keys, F.array_min(F.filter(scored, lambda a: a["aic"].isNotNull()))["p"].alias("used_lag"))
    final = rows.join(best, keys).withColumn("__lag", F.coalesce("used_lag", F.lit(0)))
    final = final.withColumns({f"__d{i}": F.when(F.col("__lag") >= i, F.col(f"__d{i}")) for i in range(1, most_lags + 1)})
    last = cross_products(final, columns, [*keys, "used_lag", "__lag"], F.col("__rn") > F.col("__lag") + 1)
    done = last.withColumn("__m", swept(F.col("m"), F.col("__lag") + 2))
    b, inverse = _entry(F.col("__m"), F.lit(1), F.lit(corner)), _entry(F.col("__m"), F.lit(1), F.lit(1))
    variance = F.try_divide(_entry(F.col("__m"), F.lit(corner), F.lit(corner)), F.col("n") - F.col("__lag") - 2)
    stat = F.try_divide(b, F.sqrt(F.when(variance * inverse > 0, variance * inverse)))
    b0, b1, b2, b3 = MACKINNON["5%"]
    n = F.col("n")
    done = done.withColumn("adf_stat", F.when(F.col("used_lag").isNotNull(), stat)).withColumn(
        "crit_5pct", F.lit(b0) + F.lit(b1) / n + F.lit(b2) / (n * n) + F.lit(b3) / (n * n * n))
    out = done.select(*keys, "n", "used_lag", "adf_stat", "crit_5pct", (F.col("adf_stat") < F.col("crit_5pct")).alias("stationary_5pct"))
    return out.drop("__one") if whole else out


def arma21(df: DataFrame, y: str = "nb_seismes", order: str = "date", by=None, long_lags: int = 8, horizon: int = 4) -> DataFrame:
    """ARMA(2, 1) with a constant by Hannan and Rissanen's two stages.

    A long autoregression (``long_lags``) gives residuals e_t that stand for
    the innovations; then y_t is regressed on y_{t-1}, y_{t-2} and e_{t-1}.
    Rows: ``by``, n (of the second stage), c, a1, a2, b1, forecast (the
    moving-average term is known for the first step only).  Series too short
    or constant have NULL coefficients.
    """
    df, keys, whole = _by(df, by)
    rows = df.select(*keys, F.col(order).alias("__o"), F.col(y).cast("double").alias("__y"))
    w = Window.partitionBy(*keys).orderBy("__o")
    lags = [f"__l{i}" for i in range(1, long_lags + 1)]
    rows = rows.withColumns({f"__l{i}": F.lag("__y", i).over(w) for i in range(1, long_lags + 1)} | {"__c": F.lit(1.0)})
    one = cross_products(rows, ["__c", *lags, "__y"], keys, F.col(lags[-1]).isNotNull())
    solved = swept(F.col("m"), F.lit(long_lags + 1))
    beta = one.select(*keys, F.transform(solved, lambda r: F.element_at(r, -1)).alias("__beta"))
    fitted = sum((F.element_at("__beta", i + 1) * F.col(f"__l{i}") for i in range(1, long_lags + 1)), F.element_at("__beta", 1))
    with_e = rows.join(beta, keys).withColumn("__e", F.when(F.col(lags[-1]).isNotNull(), F.col("__y") - fitted))
    with_e = with_e.select(*keys, "__o", "__y", "__l1", "__l2", "__c", "__e", F.lag("__e", 1).over(w).alias("__e1"))
    two = cross_products(with_e, ["__c", "__l1", "__l2", "__e1", "__y"], keys, F.col("__e1").isNotNull())
    coefficient = F.transform(swept(F.col("m"), F.lit(4)), lambda r: F.element_at(r, -1))
    last = with_e.groupBy(*keys).agg(*[F.max_by(c, "__o").alias(to) for c, to in (("__y", "__yT"), ("__l1", "__yT1"), ("__l2", "__yT2"), ("__e1", "__before"))])
    out = two.withColumn("__b", coefficient).join(last, keys).select(
        *keys, "n", *[F.element_at("__b", i + 1).alias(c) for i, c in enumerate(("c", "a1", "a2", "b1"))], "__yT", "__yT1", "__yT2", "__before")
    # the newest innovation by the fitted model itself
    newest = F.col("__yT") - (F.col("c") + F.col("a1") * F.col("__yT1") + F.col("a2") * F.col("__yT2") + F.col("b1") * F.col("__before"))
    start = F.struct(F.col("__yT").alias("p1"), F.col("__yT1").alias("p2"), newest.alias("e"), F.array().cast("array<double>").alias("fc"))

    def step(now: Column, _: Column) -> Column:
        nxt = F.col("c") + F.col("a1") * now["p1"] + F.col("a2") * now["p2"] + F.col("b1") * now["e"]
        return F.struct(nxt.alias("p1"), now["p1"].alias("p2"), F.lit(0.0).alias("e"), F.concat(now["fc"], F.array(nxt)).alias("fc"))

    out = out.withColumn("forecast", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)["fc"])
    return out.drop("__yT", "__yT1", "__yT2", "__before", *(["__one"] if whole else []))
