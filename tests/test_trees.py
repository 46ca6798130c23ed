"""Trees grown in one task equal MLlib's, and a fit takes a handful of jobs."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tremor.operators import boosting as B
from tremor.operators import ml
from tremor.operators import trees as T
from tremor.operators.encode import assemble

FEATS = list("abcdef")
SCHEMA = ", ".join(f"{c} double" for c in FEATS) + ", nb_seismes double"


def table(spark, n, odd=False, seed=0):
    """Rows of six features; odd ones have ties, zeros, constants and repeated rows."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 2, (n, 6))
    if odd:
        x[:, 1], x[:, 2], x[:, 3] = np.round(x[:, 1] * 3), 0, 7
        x[:, 4] = np.where(x[:, 4] > 1, -0.0, np.round(x[:, 4], 1) - 0.5)
        x[::7] = x[0]
    y = 10 * x[:, 1] + 5 * x[:, 0] ** 2 + rng.standard_normal(n)
    rows = [(*map(float, a), float(round(b)) if odd else float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def jobs_of(spark, call):
    group = f"test-trees-{id(call)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return call(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("n, odd, share, part, depth, rounds", [
    (200, False, "0.8", 0.8, 5, 5), (90, True, "0.34", 0.8, 3, 6), (40, True, "all", 0.5, 4, 4), (30, True, "0.2", 1.0, 6, 3), (2, False, "0.8", 0.8, 5, 3)])
def test_boosted_trees_are_those_of_mllib(spark, tmpdir_path, n, odd, share, part, depth, rounds):
    rows = assemble(table(spark, n, odd), FEATS).select("features", "nb_seismes")
    learner = GBTRegressor(maxIter=rounds, stepSize=0.1, maxDepth=depth, subsamplingRate=part, featureSubsetStrategy=share, seed=42, labelCol="nb_seismes")
    one, two = T.fit_gbt(learner, rows), learner.fit(rows)
    assert (one.getNumTrees, one.treeWeights, one.numFeatures) == (two.getNumTrees, two.treeWeights, two.numFeatures)
    assert one.featureImportances == two.featureImportances
    nodes = []
    for name, model in (("one", one), ("two", two)):
        model.save(f"{tmpdir_path}/{name}")
        nodes.append(sorted(spark.read.parquet(f"{tmpdir_path}/{name}/data").collect(), key=lambda r: (r.treeID, r.nodeData.id)))
    assert nodes[0] == nodes[1] and len(nodes[0]) >= rounds                 # every count, sum, gain and threshold


def test_a_boosted_fit_takes_few_jobs(spark):
    model, jobs = jobs_of(spark, lambda: ml.train_gbt(table(spark, 60), FEATS, max_iter=30, step=0.1, max_depth=4))
    assert model.getNumTrees == 30 and jobs < 30                            # a job a tree level before


def test_rows_that_one_task_cannot_take_stay_with_mllib(spark):
    rows = assemble(table(spark, 20), FEATS).select("features", "nb_seismes")
    assert T.fits_one_task(rows, "nb_seismes", 20) and not T.fits_one_task(rows, "nb_seismes", 19)
    assert not T.fits_one_task(rows, "nb_seismes", 0) and not T.fits_one_task(rows.limit(0), "nb_seismes")
    for odd in (None, float("nan"), float("inf")):
        assert not T.fits_one_task(rows.withColumn("nb_seismes", F.lit(odd).cast("double")), "nb_seismes")
        assert not T.fits_one_task(assemble(table(spark, 20).withColumn("b", F.lit(odd).cast("double")), FEATS), "nb_seismes")
    with pytest.raises(Exception, match="MUST NOT be NaN"):                 # MLlib refuses such a row, as before
        ml.train_gbt(table(spark, 20).withColumn("b", F.lit(None).cast("double")), FEATS, max_iter=2)


@pytest.mark.parametrize("n, odd, alpha, depth", [(120, False, 0.9, 5), (40, True, 0.1, 3), (3, False, 0.1, 4)])
def test_quantile_rounds_in_one_task_are_the_distributed_ones(spark, n, odd, alpha, depth):
    df = table(spark, n, odd, seed=4)
    one, two = (B.train_pinball(df, FEATS, alpha, rounds=3, step=0.3, max_depth=depth, one_task=k) for k in (n, n - 1))
    assert one == two and len(one.trees) == 3                               # trees, leaf values and start, to the last bit


def test_quantile_rounds_stop_when_nothing_moves(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0)] * 9, "a double, b double, nb_seismes double")
    for model in B.train_interval(df, ["a", "b"], rounds=50):
        assert model.start == 7 and len(model.trees) == 1 and model.score(np.ones((1, 2))).tolist() == [7]


def test_an_interval_fit_takes_few_jobs(spark):
    (low, high), jobs = jobs_of(spark, lambda: B.train_interval(table(spark, 60), FEATS, rounds=20, step=0.1, max_depth=4))
    assert len(low.trees) == len(high.trees) == 20 and jobs < 40            # a job a tree level, and one more a round, before
