"""The count pyramid is exact and bounds its pairs."""

import numpy as np
import pytest

from tremor.operators import neighbours as N
from tremor.operators.impute import impute_knn

FEATS = ["a", "b", "c"]


def frames(spark, receivers, donors):
    r = spark.createDataFrame([(0, *map(float, x)) for x in receivers], "__t int, a double, b double, c double")
    d = spark.createDataFrame([(0, *map(float, x), i, float(i)) for i, x in enumerate(donors)],
                              "__t int, a double, b double, c double, __did bigint, __v double")
    return r, d


def nearest(receivers, donors, k):
    out = {}
    for x in receivers:
        d2 = ((donors - x) ** 2).sum(axis=1)
        out[tuple(x)] = sorted(zip(d2.tolist(), range(len(donors))))[:k]
    return out


def found(pairs, k):
    out = {}
    for r in pairs.collect():
        out.setdefault((r.a, r.b, r.c), []).append((r["__d2"], r["__did"]))
    return {key: sorted(v)[:k] for key, v in out.items()}


def test_far_receivers_and_a_dense_cluster_keep_pairs_bounded(spark, monkeypatch):
    rng = np.random.default_rng(1)
    donors = np.concatenate([rng.normal(0, 0.01, (6000, 3)), rng.uniform(-200, 200, (40, 3))])
    receivers = rng.normal(0, 1, (300, 3)) + [5000, 5000, 5000]
    r, d = frames(spark, receivers, donors)
    made = []
    cells = N.open_cells
    monkeypatch.setattr(N, "open_cells", lambda *a: made.append(cells(*a)) or made[-1])
    pairs = N.neighbour_pairs(r, d, FEATS, 5)
    assert found(pairs, 5) == {key: [(pytest.approx(x), i) for x, i in v] for key, v in nearest(receivers, donors, 5).items()}
    size = {n["__path"]: n["__n"] for level in N.build_tree(d, FEATS)[0] for n in level.select("__path", "__n").collect()}
    compared = [size[c["__path"]] for c in made[0].select("__path").collect()]
    assert max(compared) <= N.CELL_ROWS and sum(compared) <= 300 * 8 * N.CELL_ROWS      # all pairs would be 300 * 6,040


@pytest.mark.parametrize("cell_rows, k", [(4, 5), (64, 1), (64, 7)])
def test_receivers_among_outside_and_on_the_donors(spark, cell_rows, k):
    rng = np.random.default_rng(cell_rows + k)
    donors = np.concatenate([rng.normal(0, 1, (500, 3)), np.round(rng.normal(0, 2, (300, 3))), np.tile([3.0, 3.0, 3.0], (2, 1)),
                             rng.normal(0, 1e-9, (200, 3)), [[1e6, 0, 0], [0, -1e6, 0]]])
    receivers = np.unique(np.concatenate([rng.normal(0, 3, (60, 3)), donors[:20], [[1e7, 1e7, 1e7], [3, 3, 3], [0, 0, 0]]]), axis=0)
    r, d = frames(spark, receivers, donors)
    got = found(N.neighbour_pairs(r, d, FEATS, k, cell_rows), k)
    assert got == {key: [(pytest.approx(x, rel=1e-12, abs=1e-30), i) for x, i in v] for key, v in nearest(receivers, donors, k).items()}


def test_tree_keeps_every_donor_in_one_light_cell(spark):
    rng = np.random.default_rng(6)
    donors = np.concatenate([rng.normal(0, 1e-6, (2000, 3)), rng.uniform(-50, 50, (500, 3)), np.tile([7.0, 7.0, 7.0], (5, 1))])
    _, d = frames(spark, donors[:1], donors)
    nodes, dealt = N.build_tree(d, FEATS)
    light = [n.where("not __heavy").select("__path", "__n").collect() for n in nodes]
    assert sum(r["__n"] for level in light for r in level) == len(donors)
    assert max(r["__n"] for level in light for r in level) <= N.CELL_ROWS and len(nodes) < 14
    paths = {r["__path"] for level in light for r in level}
    held = [r["__did"] for rows in dealt for r in rows.select("__path", "__did").collect() if r["__path"] in paths]
    assert sorted(held) == list(range(len(donors)))


def test_odd_features(spark):
    schema = "id bigint, latitude double, longitude double, hour int, gap double"
    rows = [(1, 0.0, 0.0, 1, 5.0), (2, 0.0, 1.0, 1, 7.0), (3, float("nan"), 0.0, 1, 100.0), (4, None, 0.0, 1, 100.0), (5, float("inf"), 0.0, 1, 100.0),
            (6, 0.0, 0.4, 1, None), (7, float("nan"), 0.0, 1, None), (8, None, 0.0, 1, None), (9, -0.0, 0.0, 1, None)]
    got = {r.id: r.gap for r in impute_knn(spark.createDataFrame(rows, schema), "gap", k=1).collect()}
    assert got == {1: 5.0, 2: 7.0, 3: 100.0, 4: 100.0, 5: 100.0, 6: 5.0, 7: None, 8: None, 9: 5.0}
    few = [(1, 0.0, 0.0, 1, 5.0), (2, 9.0, 9.0, 1, 7.0), (3, 1.0, 1.0, 1, None)]
    assert {r.id: r.gap for r in impute_knn(spark.createDataFrame(few, schema), "gap", k=5).collect()} == {1: 5.0, 2: 7.0, 3: 6.0}


def test_two_targets_have_trees_of_their_own(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-10, 10, (400, 2))
    rows = [(i, float(a), float(b), i % 24, None if i % 5 == 0 else float(i), None if i % 7 == 0 else float(-i)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, latitude double, longitude double, hour int, gap double, rms double")
    from tremor.operators.impute import knn_means
    got = {(r["__t"], round(r.latitude, 9), round(r.longitude, 9)): r["__knn"] for r in knn_means(df, ["gap", "rms"], cell_rows=16).collect()}
    for t, col in enumerate((4, 5)):
        have = [r for r in rows if r[col] is not None]
        for r in rows:
            if r[col] is None:
                near = sorted(((r[1] - d[1]) ** 2 + (r[2] - d[2]) ** 2 + (r[3] - d[3]) ** 2, d[0], d[col]) for d in have)[:5]
                assert got[t, round(r[1], 9), round(r[2], 9)] == pytest.approx(sum(v for *_, v in near) / 5)
