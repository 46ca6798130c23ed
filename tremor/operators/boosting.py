"""M9: interval models — boosted trees on the pinball loss.

A round fits an MLlib regression tree to the sign of the residuals (alpha
above the prediction, alpha - 1 below: the loss's negative gradient), then
gives each leaf the exact alpha quantile of its residuals (leaf ids from
MLlib's ``leafCol``, one grouped aggregate a round) times the step.  The
prediction starts at the label's alpha quantile.

Training state is one table (features, label, prediction so far), cached every
round, as each of a round's jobs reads it, and cut every few rounds by a
reliable checkpoint.  Rows that one task can hold (``one_task``, set by
:func:`train_interval`) go through the same rounds inside a task, without a job
a tree level; trees and leaf values are the same.  The driver holds the trees:
at most 2^depth leaves a round.  For scoring they become flat arrays that a pandas
UDF walks, a batch of rows at a time, so 500 trees are not 500 plan nodes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators.encode import assemble
from tremor.operators.quantiles import exact_quantile
from tremor.operators.together import side_by_side
from tremor.operators.trees import ONE_TASK_ROWS, Grower, dense, fits_one_task, listed
from tremor.session import materialize

# Rounds, step and depth of the interval models and their two levels.
PINBALL_CONFIG = (500, 0.05, 5)
LOW_ALPHA, HIGH_ALPHA = 0.10, 0.90

SMALL_TABLE = 1_000_000         # rows up to which a leaf's residuals are held by one aggregate
KEEP_ROUNDS = 10                # rounds between checkpoints of the training state

_LINE = re.compile(r"\s*(?:(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)|Predict: (\S+))\s*$")


@dataclass
class FlatTree:
    """A binary tree as arrays; leaves are numbered from the left, as ``leafCol`` numbers them."""

    feature: list[int] = field(default_factory=list)        # -1: a leaf
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)           # number of the leaf, or -1

    @staticmethod
    def of(model: DecisionTreeRegressionModel) -> FlatTree:
        tree, lines = FlatTree(), [m for m in map(_LINE.match, model.toDebugString.splitlines()) if m]
        at, leaves = 0, 0

        def node() -> int:
            nonlocal at, leaves
            line = lines[at]
            at += 1
            here = len(tree.feature)
            for column in (tree.feature, tree.left, tree.right, tree.leaf):
                column.append(-1)
            tree.threshold.append(0.0)
            if line[5] is not None:
                tree.leaf[here] = leaves
                leaves += 1
                return here
            tree.feature[here], tree.threshold[here] = int(line[2]), float(line[4])
            tree.left[here] = node()
            at += 1                                         # the Else line
            tree.right[here] = node()
            return here

        node()
        return tree

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf number of each row (rows by features); NaN goes right, as in MLlib."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(rows), np.int64)
        while (inner := feature[at] >= 0).any():
            here = at[inner]
            goes = rows[inner, feature[here]] <= threshold[here]
            at[inner] = np.where(goes, left[here], right[here])
        return np.array(self.leaf)[at]


@dataclass
class PinballModel:
    alpha: float
    start: float
    step: float
    trees: list[FlatTree]
    values: list[dict[int, float]]                          # leaf number -> quantile of its residuals
    features: list[str]

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        for tree, values in zip(self.trees, self.values):
            table = np.zeros(max(max(tree.leaf), 0) + 1)
            table[list(values)] = list(values.values())
            out += self.step * table[tree.leaves_of(rows)]
        return out

    def predict(self, df: DataFrame, out: str = "yhat") -> DataFrame:
        """``df`` with the model's quantile, clamped at 0."""
        score = self.score

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            rows = np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns])
            return pd.Series(np.maximum(0.0, score(rows)))

        return df.withColumn(out, scored(*[F.col(c).cast("double") for c in self.features]))


def pinball_loss(y: Column, yhat: Column, alpha: float) -> Column:
    """alpha (y - yhat) above the prediction, (1 - alpha)(yhat - y) below."""
    return F.greatest(F.lit(alpha) * (y - yhat), F.lit(alpha - 1) * (y - yhat))


def leaf_quantiles(rows: DataFrame, leaf: str, residual: str, alpha: float, small: bool) -> dict[int, float]:
    """Leaf number -> exact alpha quantile of its residuals: one aggregate, or
    the bounded-memory quantile for tables whose leaves do not fit in one."""
    if small:
        found = rows.groupBy(leaf).agg(F.percentile(residual, alpha).alias("value"))
    else:
        found = exact_quantile(rows, residual, alpha, [leaf], out="value")
    return {int(r[leaf]): float(r["value"]) for r in found.collect()}


def _percentile(values: np.ndarray, p: float) -> float:
    """Spark's exact ``percentile``."""
    at = (len(values) - 1) * p
    low, high = math.floor(at), math.ceil(at)
    found = np.sort(values)
    a, b = float(found[low]), float(found[high])
    return a if low == high or a == b else (high - at) * a + (at - low) * b


_ROUND_SCHEMA = "number int, feature array<int>, threshold array<double>, left array<int>, right array<int>, leaf array<int>, leaf_values array<double>"
_ROUND_COLUMNS = [("number", pa.int32()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())),
                  ("right", pa.list_(pa.int32())), ("leaf", pa.list_(pa.int32())), ("leaf_values", pa.list_(pa.float64()))]


def _rounds_in_task(model: PinballModel, rows: DataFrame, rounds: int, max_depth: int) -> PinballModel:
    """The rounds of :func:`train_pinball` over one partition in one task."""
    alpha, start, step = model.alpha, model.start, model.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dense(batches)
        if found is None:
            return
        x, y = found
        grower, f = Grower(x, max_depth), np.full(len(y), start)
        for number in range(rounds):
            tree, leaf, _ = grower.grow(np.where(y > f, alpha, alpha - 1))
            residual = y - f
            values = np.array([_percentile(residual[leaf == k], alpha) for k in range(tree.leaves)])
            row = (number, tree.feature, tree.threshold, tree.left, tree.right, tree.leaf, values)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _ROUND_COLUMNS)], [name for name, _ in _ROUND_COLUMNS])
            if not values.any():
                return                                      # every later round would be this one again
            f = f + step * values[leaf]

    for r in sorted(listed(rows, "y").mapInArrow(run, _ROUND_SCHEMA).collect(), key=lambda r: r["number"]):
        model.trees.append(FlatTree(r["feature"], r["threshold"], r["left"], r["right"], r["leaf"]))
        model.values.append(dict(enumerate(r["leaf_values"])))
    return model


def train_pinball(train: DataFrame, feats, alpha: float, label: str = "nb_seismes", rounds: int = PINBALL_CONFIG[0],
                  step: float = PINBALL_CONFIG[1], max_depth: int = PINBALL_CONFIG[2], partitions: int | None = 1,
                  small_table: int = SMALL_TABLE, keep_rounds: int = KEEP_ROUNDS, one_task: int = 0) -> PinballModel:
    """M9: a boosted model of the label's ``alpha`` quantile.

    Rows with a NULL label are left out; without rows the model predicts 0.
    ``partitions`` as in :func:`tremor.operators.ml.train_gbt`.  Rows of one
    partition, up to ``one_task`` and none with a missing or infinite value, are
    fitted in one task: the same model.
    """
    feats = list(feats)
    rows = assemble(train.where(F.col(label).isNotNull()), feats).select("features", F.col(label).cast("double").alias("y"))
    rows = materialize(rows.coalesce(partitions) if partitions else rows)
    n = rows.count()
    model = PinballModel(alpha, 0.0, step, [], [], feats)
    if not n:
        return model
    small = n <= small_table
    model.start = leaf_quantiles(rows.withColumn("leaf", F.lit(0)), "leaf", "y", alpha, small)[0]
    if partitions == 1 and fits_one_task(rows, "y", one_task):
        return _rounds_in_task(model, rows, rounds, max_depth)
    learner = DecisionTreeRegressor(maxDepth=max_depth, labelCol="slope", featuresCol="features", leafCol="leaf", predictionCol="mean")
    state, kept = rows.withColumn("f", F.lit(model.start)), []        # kept: cached since the last checkpoint
    for number in range(rounds):
        sloped = state.withColumn("slope", F.when(F.col("y") > F.col("f"), F.lit(alpha)).otherwise(F.lit(alpha - 1)))
        tree = learner.fit(sloped)
        placed = tree.transform(state).withColumn("residual", F.col("y") - F.col("f"))
        values = leaf_quantiles(placed, "leaf", "residual", alpha, small)
        model.trees.append(FlatTree.of(tree))
        model.values.append(values)
        if all(v == 0 for v in values.values()):
            break                                           # every later round would be this one again
        table = F.array(*[F.lit(values.get(i, 0.0)) for i in range(max(values) + 1)])
        state = placed.select("features", "y", (F.col("f") + F.lit(step) * F.get(table, F.col("leaf").cast("int"))).alias("f"))
        if (number + 1) % keep_rounds == 0:
            state = materialize(state)
            for old in kept:
                old.unpersist()
            kept = []
        else:
            state = state.persist()
            kept.append(state)
    for old in kept:
        old.unpersist()
    return model


def train_interval(train: DataFrame, feats, alphas=(LOW_ALPHA, HIGH_ALPHA), one_task: int = ONE_TASK_ROWS, **kwargs) -> list[PinballModel]:
    """The models of several quantiles, fitted side by side."""
    train = materialize(train)
    return side_by_side(train.sparkSession, [lambda a=a: train_pinball(train, feats, a, one_task=one_task, **kwargs) for a in alphas])


def apply_quantile_interval(pred: DataFrame, low: PinballModel, high: PinballModel, yhat: str = "yhat") -> DataFrame:
    """M9: ``quantile_lo`` and ``quantile_hi`` around the central prediction, low <= central <= high."""
    out = high.predict(low.predict(pred, "quantile_lo"), "quantile_hi")
    return out.withColumn("quantile_lo", F.least("quantile_lo", yhat)).withColumn("quantile_hi", F.greatest("quantile_hi", yhat))
