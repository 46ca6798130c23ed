"""M9 quantile boosting, M7 stopping rule, side-by-side fits."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import boosting as B
from tremor.operators import ml
from tremor.operators.encode import assemble
from tremor.operators.together import side_by_side

FEATS = ["a", "b", "c"]


def noisy(spark, n=300, seed=3):
    """The spread of y grows with a, so its quantiles are no shift of its mean."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 2, (n, 3))
    y = 50 + 10 * x[:, 1] + (1 + 12 * x[:, 0]) * rng.standard_normal(n)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, nb_seismes double").coalesce(1), x, y


def loss(y, f, alpha):
    return np.maximum(alpha * (y - f), (alpha - 1) * (y - f)).mean()


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.9])
def test_leaf_values_equal_brute_force(spark, alpha):
    df, x, y = noisy(spark, 120)
    model = B.train_pinball(df, FEATS, alpha, rounds=8, step=0.3, max_depth=3, keep_rounds=3)
    assert model.start == pytest.approx(np.quantile(y, alpha)) and len(model.trees) == 8
    f = np.full(len(y), model.start)
    before = loss(y, f, alpha)
    for tree, values in zip(model.trees, model.values):
        leaf = tree.leaves_of(x)
        assert set(leaf) == set(values)
        for k in set(leaf):
            assert values[k] == pytest.approx(np.quantile((y - f)[leaf == k], alpha), abs=1e-9)
        f = f + 0.3 * np.array([values[k] for k in leaf])
        now = loss(y, f, alpha)
        assert now <= before + 1e-9          # a quantile never raises a leaf's loss, nor does a part of the way
        before = now
    assert np.allclose(model.score(x), f)
    assert before < 0.95 * loss(y, np.full(len(y), model.start), alpha)
    got = [r.yhat for r in model.predict(df).select("yhat").collect()]
    assert np.allclose(got, np.maximum(0, f))


def test_flat_trees_place_rows_as_mllib_does(spark):
    from pyspark.ml.regression import DecisionTreeRegressor
    df, x, y = noisy(spark, 200, 9)
    tree = DecisionTreeRegressor(maxDepth=5, labelCol="nb_seismes", leafCol="leaf").fit(assemble(df, FEATS))
    placed = [int(r.leaf) for r in tree.transform(assemble(df, FEATS)).select("leaf").collect()]
    flat = B.FlatTree.of(tree)
    assert flat.leaves_of(x).tolist() == placed and max(placed) > 8
    assert sorted(k for k in flat.leaf if k >= 0) == list(range(max(flat.leaf) + 1))


def test_interval_orders_and_beats_constants(spark):
    df, x, y = noisy(spark, 600, 5)
    low, high = B.train_interval(df, FEATS, rounds=25, step=0.15, max_depth=3)
    fresh, x2, y2 = noisy(spark, 400, 77)
    scored = B.apply_quantile_interval(fresh.withColumn("yhat", F.lit(60.0)), low, high)
    rows = scored.select("nb_seismes", "yhat", "quantile_lo", "quantile_hi").collect()
    assert all(r.quantile_lo <= r.yhat <= r.quantile_hi for r in rows)
    lo, hi = np.maximum(0, low.score(x2)), np.maximum(0, high.score(x2))
    assert loss(y2, lo, 0.1) < loss(y2, np.full(400, low.start), 0.1) and loss(y2, hi, 0.9) < loss(y2, np.full(400, high.start), 0.9)
    assert 0.68 <= np.mean((y2 >= lo) & (y2 <= hi)) <= 0.92
    assert np.corrcoef(hi - lo, x2[:, 0])[0, 1] > 0.6                    # wide where the spread is
    col = fresh.select(B.pinball_loss(F.col("nb_seismes"), F.lit(low.start), 0.1).alias("l")).agg(F.avg("l")).first()[0]
    assert col == pytest.approx(loss(y2, low.start, 0.1))


def test_large_tables_use_the_bounded_quantile_with_equal_values(spark):
    df, x, y = noisy(spark, 90)
    one = B.train_pinball(df, FEATS, 0.9, rounds=2, step=0.3, max_depth=2)
    two = B.train_pinball(df, FEATS, 0.9, rounds=2, step=0.3, max_depth=2, small_table=10)
    assert np.allclose(one.score(x), two.score(x))


def test_odd_training_rows(spark):
    schema = "a double, b double, c double, nb_seismes double"
    none = B.train_pinball(spark.createDataFrame([], schema), FEATS, 0.9, rounds=3)
    assert none.trees == [] and none.score(np.ones((2, 3))).tolist() == [0, 0]
    flat = B.train_pinball(spark.createDataFrame([(1.0, 2.0, 3.0, 7.0)] * 9 + [(1.0, 2.0, 3.0, None)], schema), FEATS, 0.1, rounds=50)
    assert flat.start == 7 and len(flat.trees) == 1 and flat.score(np.ones((1, 3))).tolist() == [7]


def test_rounds_stop_only_without_gain():
    assert ml.stop_round([5, 4, 3, 2, 1], 2) == 5
    assert ml.stop_round([5, 4, 4.5, 4.5, 1], 2) == 2
    assert ml.stop_round([5, 4, 4.5, 3.9999, 4, 3.9998], 2) == 6         # any gain counts, however small
    assert ml.stop_round([3], 50) == 1


def test_side_by_side_keeps_order_pools_and_errors(spark):
    seen = threading.Barrier(3, timeout=60)

    def call(k):
        seen.wait()                                                    # ends only if all three run at once
        return k, spark.range(10 * k).count(), spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    assert side_by_side(spark, [lambda k=k: call(k) for k in (1, 2, 3)]) == [(k, 10 * k, f"side-{k - 1}") for k in (1, 2, 3)]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 // 0])
    assert side_by_side(spark, [lambda: 4]) == [4] and side_by_side(spark, []) == []


def test_rounds_read_a_cached_state(spark, monkeypatch):
    """Each of a round's jobs reads the state; it is computed once, and nothing stays cached."""
    read, fit = [], B.DecisionTreeRegressor.fit

    def seen(self, df, *args):
        read.append("InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString())
        return fit(self, df, *args)

    monkeypatch.setattr(B.DecisionTreeRegressor, "fit", seen)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    rows = spark.createDataFrame([(float(i % 17), float((i * 37) % 101)) for i in range(60)], "x double, nb_seismes double")
    B.train_pinball(rows, ["x"], 0.5, rounds=5, max_depth=2, keep_rounds=3)
    assert read == [False, True, True, False, True]             # the first and the one after a checkpoint read files
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
