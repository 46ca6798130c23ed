"""Geographic zones: scaler (M1), k-means (M2), nearest-centre assignment.

Assignment never joins events with centres: the k centres are literals
inside one per-row expression (k distances, ``least``, a ``CASE`` chain) —
k distance evaluations per row, exactly what ``KMeansModel.predict`` does,
with no pair rows emitted.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators.common import attach_row


def scaler_stats(df: DataFrame, cols=("latitude", "longitude"), population: bool = True) -> DataFrame:
    """M1 (SQL form): one row of means and sds; population sd matches
    scikit-learn, sample sd matches MLlib (SURVEY D10)."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for c in cols:
        # a zero-variance axis is scaled by 1, as scikit-learn's scaler does
        aggs += [F.avg(c).alias(f"{c}_mean"),
                 F.when(sd(c) > 0, sd(c)).otherwise(F.lit(1.0)).alias(f"{c}_sd")]
    return df.where(F.col(cols[0]).isNotNull() & F.col(cols[1]).isNotNull()).agg(*aggs)


def standardise(df: DataFrame, stats: DataFrame, cols=("latitude", "longitude")) -> DataFrame:
    """M1: (x - mean) / sd with the one-row stats attached as a scalar subquery."""
    out = attach_row(df, stats)
    out = out.withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in cols})
    return out.drop(*[f"{c}_{s}" for c in cols for s in ("mean", "sd")])


def nearest_centre(x: Column, y: Column, centres: list[tuple[int, float, float]],
                   sx: Column | None = None, sy: Column | None = None) -> Column:
    """Id of the nearest (x, y) centre; ties go to the smaller id.

    ``centres`` is a small fixed list (k entries, the model parameters).
    With per-axis scales ``sx``/``sy`` the distance is measured on
    standardised coordinates: ((x-cx)/sx)^2 + ((y-cy)/sy)^2 — the means cancel.
    The k distances are unrolled into plain arithmetic, ``least`` and a
    ``CASE`` chain, so the whole assignment compiles into the scan's
    whole-stage-codegen function (no per-row lambda).
    """
    sx = sx if sx is not None else F.lit(1.0)
    sy = sy if sy is not None else F.lit(1.0)
    ordered = sorted(centres, key=lambda c: c[0])
    dists = []
    for _, cx, cy in ordered:
        dx = (x - F.lit(float(cx))) / sx
        dy = (y - F.lit(float(cy))) / sy
        dists.append(dx * dx + dy * dy)
    if len(dists) == 1:
        return F.lit(int(ordered[0][0]))
    best = F.least(*dists)
    expr = None
    for (zone, _, _), d in zip(ordered, dists):  # first match = smallest id among ties
        expr = F.when(d == best, F.lit(int(zone))) if expr is None else expr.when(d == best, F.lit(int(zone)))
    return expr


def assign_zone_scaled(df: DataFrame, centres: list[tuple[int, float, float]],
                       stats: DataFrame) -> DataFrame:
    """J7 on standardised coordinates (centres given in degrees).

    The scaler's one-row stats come in as one scalar subquery; the
    assignment is a per-row expression, so the plan is scan -> project.
    """
    pts = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    out = attach_row(pts, stats.select("latitude_sd", "longitude_sd"))
    zone = nearest_centre(F.col("latitude"), F.col("longitude"), centres,
                          F.col("latitude_sd"), F.col("longitude_sd"))
    return out.withColumn("zone", zone).drop("latitude_sd", "longitude_sd")


def fit_zones(df: DataFrame, k: int = 10, seed: int = 42, max_iter: int = 20):
    """M1 + M2: standardise (lat, lon) and fit k-means with MLlib.

    Returns (scaler_model, kmeans_model).  MLlib's k-means|| initialisation
    and Lloyd iterations run distributed; only the k centres reach the driver.
    """
    pts = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    vec = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="coords").transform(pts)
    scaler = StandardScaler(inputCol="coords", outputCol="features", withMean=True, withStd=True).fit(vec)
    km = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="zone").fit(
        scaler.transform(vec))
    return scaler, km


def assign_zone_model(df: DataFrame, scaler, km: KMeansModel) -> DataFrame:
    """J7 / T6 with fitted models (works on batch and streaming frames)."""
    pts = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    vec = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="coords").transform(pts)
    return km.transform(scaler.transform(vec)).drop("coords", "features")
