"""Forecasting models on MLlib.

Training sets here are rollup outputs (one row per week or zone-week), so
they are small; MLlib still distributes tree building and scoring.  The
interval is split-conformal: MLlib's boosted trees have no quantile loss,
so calibration residual quantiles are added to the central prediction.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators.common import attach_row
from tremor.operators.encode import assemble
from tremor.operators.together import side_by_side
from tremor.operators.trees import fit_gbt, fits_one_task
from tremor.session import materialize


def minmax(df: DataFrame, cols) -> DataFrame:
    """M3: (x - min) / (max - min) per column (0 when the column is constant).

    min/max come from one global aggregate attached as a scalar subquery.
    """
    cols = list(cols)
    stats = df.agg(*[F.min(c).alias(f"__lo_{c}") for c in cols], *[F.max(c).alias(f"__hi_{c}") for c in cols])
    out = attach_row(df, stats)
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}")),
                            F.lit(0.0)) for c in cols}
    return out.withColumns(scaled).drop(*[f"__{s}_{c}" for c in cols for s in ("lo", "hi")])


def train_rf(train: DataFrame, feats, label: str = "nb_seismes", num_trees: int = 500,
             max_depth: int = 10, min_leaf: int = 5, seed: int = 42):
    """M6: random-forest regression (reference size: 500 trees, depth 10, leaf 5)."""
    rf = RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_leaf,
                               seed=seed, labelCol=label, featuresCol="features")
    return rf.fit(assemble(train, list(feats)))


def truncate(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The boosted model's first ``rounds`` trees as a model of their own."""
    if rounds >= model.getNumTrees:
        return model
    sc = SparkContext._active_spark_context
    trees, weights = model._java_obj.trees(), model.treeWeights
    some = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    share = sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        some[i], share[i] = trees[i], float(weights[i])
    cut = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{model.uid}_{rounds}", some, share)
    return GBTRegressionModel(cut).setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def train_gbt(train: DataFrame, feats, label: str = "nb_seismes", max_iter: int = 1000,
              step: float = 0.03, max_depth: int = 5, subsample: float = 0.8,
              validation_col: str | None = None, patience: int = 50, seed: int = 42,
              partitions: int | None = 1, column_share: str = "0.8"):
    """M7: boosted trees.

    With ``validation_col`` (a validation slice, never the test set — SURVEY
    D9) the model keeps the rounds up to the least validation error before the
    first ``patience`` rounds in a row without any gain.  All rounds are fitted once and the error of
    every prefix is read from that one model.  Without it all ``max_iter``
    rounds are kept.  MLlib's own early stop ends at the first small gain,
    which with small steps is the first round, so it is not used.

    Training rows are rollup rows (a row per week or zone-week); ``partitions``
    keeps them together, as a round is a handful of tiny jobs.  None leaves
    them as they come, for tables of many zones.  The features are computed
    by all tasks before that.  Rows kept in one partition that one task can hold
    (:func:`tremor.operators.trees.fits_one_task`) are fitted inside a task: the same model.
    """
    rows = materialize(assemble(train, list(feats)).select("features", F.col(label).cast("double").alias(label),
                                                           *([validation_col] if validation_col else [])))
    if partitions:
        rows = rows.coalesce(partitions)
    fitted = rows.where(~F.col(validation_col)) if validation_col else rows
    learner = GBTRegressor(maxIter=max_iter, stepSize=step, maxDepth=max_depth, subsamplingRate=subsample, featureSubsetStrategy=column_share,
                           seed=seed, labelCol=label, featuresCol="features")
    model = fit_gbt(learner, fitted) if partitions == 1 and fits_one_task(fitted, label) else learner.fit(fitted)
    if not validation_col:
        return model
    return truncate(model, stop_round(model.evaluateEachIteration(rows.where(F.col(validation_col)), "squared"), patience))


def stop_round(errors: list[float], patience: int) -> int:
    """Rounds to keep: those up to the least error, looking no further than
    the first ``patience`` rounds without a lower one."""
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


# The three boosted configurations (rounds, step, depth).
GBT_CONFIGS = {"gbt": (1000, 0.03, 5), "gbt_walk_forward": (500, 0.05, 5), "gbt_zone": (200, 0.05, 6)}


def predict(model, df: DataFrame, feats, out: str = "yhat") -> DataFrame:
    """Score rows, clamp at 0 (P16 without the int cast)."""
    scored = model.transform(assemble(df, list(feats)))
    return scored.withColumn(out, F.greatest(F.col("prediction"), F.lit(0.0))).drop("features", "prediction")


def conformal_bounds(calib: DataFrame, y: str = "y", yhat: str = "yhat", alpha_lo: float = 0.10,
                     alpha_hi: float = 0.90) -> DataFrame:
    """M9: one row of residual quantiles (y - yhat) on a calibration slice."""
    r = F.col(y) - F.col(yhat)
    q = F.percentile(r, F.array(F.lit(alpha_lo), F.lit(alpha_hi)))
    return (calib.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
            .agg(q.alias("__q")).select(F.col("__q")[0].alias("q_lo"), F.col("__q")[1].alias("q_hi")))


def apply_interval(pred: DataFrame, bounds: DataFrame, yhat: str = "yhat") -> DataFrame:
    """M9: lo = max(yhat + q_lo, 0), hi = yhat + q_hi, with lo <= yhat <= hi."""
    out = attach_row(pred, bounds)
    lo = F.least(F.greatest(F.col(yhat) + F.col("q_lo"), F.lit(0.0)), F.col(yhat))
    hi = F.greatest(F.col(yhat) + F.col("q_hi"), F.col(yhat))
    return out.withColumn("lo", lo).withColumn("hi", hi).drop("q_lo", "q_hi")


def interval_fallback(pred: DataFrame, yhat: str = "central", width: int = 50) -> DataFrame:
    """Fixed +-width interval when no interval model is present."""
    return pred.withColumn("low", F.greatest(F.col(yhat) - width, F.lit(0))).withColumn("high", F.col(yhat) + width)


def walk_forward(df: DataFrame, feats, fit, n_splits: int = 5, order: str = "date",
                 label: str = "nb_seismes") -> DataFrame:
    """Expanding folds (W16), one fit per fold, side by side; rows (fold, mae)."""
    from tremor.operators.windows import ts_folds
    folds = materialize(ts_folds(df, n_splits, order))

    def score(f: int) -> DataFrame:
        part = folds.where(F.col("fold") == f)
        model = fit(part.where(F.col("role") == "train"))
        scored = predict(model, part.where(F.col("role") == "val"), feats)
        return scored.agg(F.avg(F.abs(F.col(label) - F.col("yhat"))).alias("mae")).withColumn("fold", F.lit(f))

    parts = side_by_side(df.sparkSession, [lambda f=f: score(f) for f in range(1, n_splits + 1)])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
