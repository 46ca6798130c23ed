"""KNN imputation against brute force; series statistics against NumPy."""

import math

import numpy as np
from pyspark.sql import functions as F

from tremor.operators.impute import impute_knn, impute_median
from tremor.operators.series import ar2, durbin_levinson, holt_winters, pacf


def _brute(rows, k=5):
    donors = [(i, x, y, z, v) for i, x, y, z, v in rows if v is not None]
    out = {}
    for i, x, y, z, v in rows:
        if v is not None:
            out[i] = v
            continue
        ds = sorted(((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, j, w) for j, a, b, c, w in donors)[:k]
        out[i] = sum(w for _, _, w in ds) / len(ds) if ds else None
    return out


def test_knn_exact_with_duplicates_and_sparse_points(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        if i < 150:  # a hot point: many identical coordinates
            x, y, z = 10.0, 10.0, 3.0
        else:
            x, y, z = float(rng.integers(-90, 90)), float(rng.integers(-180, 180)), float(rng.integers(0, 24))
        v = None if rng.random() < 0.3 else float(rng.normal(50, 10))
        rows.append((i, x, y, z, v))
    rows.append((999, 500.0, 500.0, 0.0, None))  # isolated receiver: resolved at a coarse level
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double, hour double, gap double")
    got = {r.id: r.gap for r in impute_knn(df, "gap").collect()}
    want = _brute(rows)
    assert got.keys() == want.keys()
    for i in want:
        assert math.isclose(got[i], want[i], rel_tol=1e-12), i


def test_knn_all_null_stays_null(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, None), (2, 1.0, 1.0, 1.0, None)],
                               "id int, latitude double, longitude double, hour double, gap double")
    assert [r.gap for r in impute_knn(df, "gap").collect()] == [None, None]


def test_impute_median(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "x double")
    assert sorted(r.x for r in impute_median(df, ["x"]).collect()) == [1.0, 3.0, 3.0, 10.0]


def test_durbin_levinson_ar1(spark):
    phi = 0.6
    r = [phi ** k for k in range(6)]
    p = spark.createDataFrame([(r,)], "r array<double>").select(durbin_levinson("r", 5)).first()[0]
    assert math.isclose(p[1], phi) and all(abs(v) < 1e-12 for v in p[2:])


def _ar2_series(n=400, c=5.0, a1=0.5, a2=-0.3, seed=1):
    rng = np.random.default_rng(seed)
    y = [10.0, 10.0]
    for _ in range(n):
        y.append(c + a1 * y[-1] + a2 * y[-2] + rng.normal(0, 1))
    return y


def test_ar2_recovers_coefficients(spark):
    y = _ar2_series()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "date int, nb_seismes double")
    r = ar2(df, horizon=3).first()
    yy = np.array(y)
    X = np.column_stack([np.ones(len(yy) - 2), yy[1:-1], yy[:-2]])
    c, a1, a2 = np.linalg.lstsq(X, yy[2:], rcond=None)[0]
    assert math.isclose(r.a1, a1, rel_tol=1e-9) and math.isclose(r.a2, a2, rel_tol=1e-9)
    assert math.isclose(r.c, c, rel_tol=1e-9) and len(r.forecast) == 3
    assert math.isclose(r.forecast[0], r.c + r.a1 * y[-1] + r.a2 * y[-2], rel_tol=1e-9)


def test_pacf_and_holt_winters_per_series(spark):
    rows = [(z, i, float(v)) for z in (1, 2) for i, v in enumerate(_ar2_series(200, seed=z))]
    df = spark.createDataFrame(rows, "zone int, date int, nb_seismes double")
    p = pacf(df, max_lag=5, by=["zone"]).collect()
    assert len(p) == 12 and all(r.pacf == 1.0 for r in p if r.lag == 0)
    hw = holt_winters(df, period=52, by=["zone"], horizon=4).collect()
    assert len(hw) == 2 and all(len(r.forecast) == 4 and r.sse > 0 for r in hw)
    tuned = {r.zone: r.sse for r in holt_winters(df, period=52, by=["zone"], optimize=True).collect()}
    assert all(tuned[r.zone] <= r.sse + 1e-9 for r in hw)
    _ = F


def test_knn_exact_on_clustered_points(spark):
    """A tight cluster of distinct points next to sparse ones: cells are
    refined for the cluster and the sparse receivers climb levels."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(500):
        if i < 350:
            x, y, z = (float(v) for v in rng.uniform(0, 0.01, 3))
        else:
            x, y, z = (float(v) for v in rng.uniform(-100, 100, 3))
        v = None if rng.random() < 0.25 else float(rng.normal(0, 1))
        rows.append((i, x, y, z, v))
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double, hour double, gap double")
    got = {r.id: r.gap for r in impute_knn(df, "gap").collect()}
    want = _brute(rows)
    for i in want:
        assert math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-12), i


def test_dickey_fuller_matches_ols(spark):
    y = np.array(_ar2_series(150, seed=5))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "date int, nb_seismes double")
    from tremor.operators.series import dickey_fuller
    r = dickey_fuller(df).first()
    dy, x = np.diff(y), y[:-1]
    X = np.column_stack([np.ones(len(x)), x])
    coef, res, *_ = np.linalg.lstsq(X, dy, rcond=None)
    sigma2 = res[0] / (len(x) - 2)
    se = math.sqrt(sigma2 * np.linalg.inv(X.T @ X)[1, 1])
    assert math.isclose(r.beta, coef[1], rel_tol=1e-9) and math.isclose(r.df_stat, coef[1] / se, rel_tol=1e-9)


def test_decompose_matches_numpy(spark):
    rng = np.random.default_rng(2)
    period, n = 12, 60
    y = 10 + np.sin(2 * np.pi * np.arange(n) / period) * 3 + rng.normal(0, 0.5, n) + np.arange(n) * 0.1
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "date int, nb_seismes double")
    from tremor.operators.series import decompose
    got = {r.date: r for r in decompose(df, period=period).collect()}
    w = np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.full(n, np.nan)
    half = period // 2
    for t in range(half, n - half):
        trend[t] = np.dot(w, y[t - half:t + half + 1])
    detr = y - trend
    phase_means = np.array([np.nanmean(detr[p::period]) for p in range(period)])
    seasonal = (phase_means - phase_means.mean())[np.arange(n) % period]
    for t in range(n):
        if np.isnan(trend[t]):
            assert got[t].trend is None
        else:
            assert math.isclose(got[t].trend, trend[t], rel_tol=1e-9)
            assert math.isclose(got[t].resid, y[t] - trend[t] - seasonal[t], rel_tol=1e-7, abs_tol=1e-9)
        assert math.isclose(got[t].seasonal, seasonal[t], rel_tol=1e-9, abs_tol=1e-12)


def test_pacf_matches_yule_walker(spark):
    y = np.array(_ar2_series(300, seed=9))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "date int, nb_seismes double")
    got = {r.lag: r.pacf for r in pacf(df, max_lag=6).collect()}
    d = y - y.mean()
    r = np.array([np.sum(d[k:] * d[:len(d) - k]) / np.sum(d * d) for k in range(7)])
    for k in range(1, 7):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(toeplitz, r[1:k + 1])
        assert math.isclose(got[k], phi[-1], rel_tol=1e-7, abs_tol=1e-10)


def test_refined_exact_quantile_matches_percentile(spark):
    from tremor.operators.quantiles import exact_quantile
    rng = np.random.default_rng(1)
    rows = []
    for g, n in enumerate([1, 2, 999, 4000]):
        rows += [(g, float(v)) for v in rng.normal(0, 1, n)]
    rows += [(7, float(v)) for v in np.round(rng.normal(0, 1, 3000), 1)]  # many ties
    rows += [(9, None), (9, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    for p in (0.5, 0.33, 0.9):
        got = {r.g: r.q for r in exact_quantile(df, "v", p, ["g"], small=20, out="q").collect()}
        want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", p).alias("q")).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12), (p, k)


def test_impute_median_equals_percentile(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(v) if rng.random() > 0.2 else None, float(w) if rng.random() > 0.3 else None, 1.0)
            for i, (v, w) in enumerate(zip(rng.normal(0, 1, 2000), rng.normal(5, 2, 2000)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    m = df.agg(F.median("a").alias("a"), F.median("b").alias("b")).first()
    got = {r.id: (r.a, r.b, r.c) for r in impute_median(df, ["a", "b", "c"]).collect()}
    assert all(got[i] == (m.a if a is None else a, m.b if b is None else b, c) for i, a, b, c in rows)


def test_quantile_of_heavy_tails_and_infinities(spark):
    """Values that equal-width bins cannot separate; both sides of ``small``."""
    from tremor.operators.quantiles import exact_quantile
    tail = spark.range(20000).select(F.pow(F.lit(10.0), F.col("id") * 0.025 - 300).alias("x"))
    for p in (0.25, 0.5, 0.999):
        want = tail.agg(F.percentile("x", p)).first()[0]
        for small in (50, 100_000):
            assert math.isclose(exact_quantile(tail, "x", p, [], small=small).first()[0], want, rel_tol=1e-12)
    odd = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (math.inf,), (-math.inf,), (None,), (math.nan,)], "x double")
    for small in (1, 2, 50):
        assert [exact_quantile(odd, "x", p, [], small=small).first()[0] for p in (0.0, 0.4, 0.6, 1.0)] == [-math.inf, 2.0, 3.0, math.inf]
    assert exact_quantile(odd.where("x is null"), "x", 0.5, []).first()[0] is None
    groups = spark.createDataFrame([(None, 1.0), (None, 3.0), (7, None)], "g int, x double")
    assert {r.g: r.q_x for r in exact_quantile(groups, "x", 0.5, ["g"], small=1).collect()} == {None: 2.0, 7: None}


def test_quantile_plan_has_no_pair_join(spark):
    import io
    from contextlib import redirect_stdout

    from tremor.operators.quantiles import exact_quantile
    for by in ([], ["g"]):
        buf = io.StringIO()
        with redirect_stdout(buf):
            exact_quantile(spark.range(500).selectExpr("id % 3 AS g", "id * 1.5D AS x"), "x", 0.5, by, small=10).explain("formatted")
        assert "NestedLoop" not in buf.getvalue() and "Cartesian" not in buf.getvalue()


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_pt = st.tuples(st.integers(-6, 6), st.integers(-6, 6), st.integers(0, 5),
                st.one_of(st.none(), st.floats(-50, 50, allow_nan=False)))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_pt, min_size=2, max_size=40), st.integers(1, 5))
def test_knn_exact_property(spark, pts, k):
    """Any small layout (duplicates, ties, all-null targets): grid KNN equals brute force."""
    rows = [(i, float(x), float(y), float(z), v) for i, (x, y, z, v) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double, hour double, gap double")
    got = {r.id: r.gap for r in impute_knn(df, "gap", k=k).collect()}
    want = _brute(rows, k=k)
    for i, w in want.items():
        if w is None:
            assert got[i] is None
        else:
            assert got[i] is not None and math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-9), (i, got[i], w)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False),
                                                       st.sampled_from([0.0, 1.5, -2.25]))),
                min_size=1, max_size=60),
       st.sampled_from([0.0, 0.1, 0.33, 0.5, 0.66, 0.9, 1.0]), st.integers(1, 8))
def test_refined_quantile_property(spark, rows, p, small):
    """Refined exact quantiles equal Spark's exact percentile on any layout."""
    from tremor.operators.quantiles import exact_quantile
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.q for r in exact_quantile(df, "v", p, ["g"], small=small, out="q").collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", p).alias("q")).collect()}
    for g, w in want.items():
        if w is None:
            assert got.get(g) is None
        else:
            assert math.isclose(got[g], w, rel_tol=1e-9, abs_tol=1e-9), (g, got.get(g), w)


def test_constant_series_give_nulls_not_failures(spark):
    """A zone whose weekly count never changes must not fail the job."""
    from tremor.operators.geo import assign_zone_scaled, scaler_stats
    from tremor.operators.series import dickey_fuller
    from tremor.operators.stats import acf, regression_metrics
    df = spark.createDataFrame([(i, 4.0) for i in range(30)], "date int, nb_seismes double")
    assert all(r.acf is None for r in acf(df, "nb_seismes", 3).collect())
    d = dickey_fuller(df).first()
    assert d.beta is None and d.df_stat is None
    assert ar2(df).first().a1 is None
    m = regression_metrics(df.selectExpr("nb_seismes AS y", "nb_seismes + 1 AS yhat")).first()
    assert m.r2 is None and m.mae == 1.0
    pts = spark.createDataFrame([(i, 10.0, float(i)) for i in range(5)], "id int, latitude double, longitude double")
    zones = assign_zone_scaled(pts, [(0, 10.0, 0.0), (1, 10.0, 4.0)], scaler_stats(pts)).collect()
    assert {r.id: r.zone for r in zones} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4), st.integers(0, 3),
                          st.one_of(st.none(), st.floats(-9, 9, allow_nan=False)),
                          st.one_of(st.none(), st.floats(-9, 9, allow_nan=False))), min_size=2, max_size=30))
def test_knn_two_columns_property(spark, pts):
    """Several columns in one job equal each column imputed alone (brute force)."""
    from tremor.operators.impute import impute_knn_many
    rows = [(i, float(x), float(y), float(z), a, b) for i, (x, y, z, a, b) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double, hour double, gap double, rms double")
    got = {r.id: (r.gap, r.rms) for r in impute_knn_many(df, ["gap", "rms"], k=3).collect()}
    want_gap = _brute([(i, x, y, z, a) for i, x, y, z, a, _ in rows], k=3)
    want_rms = _brute([(i, x, y, z, b) for i, x, y, z, _, b in rows], k=3)
    for i in want_gap:
        for g, w in ((got[i][0], want_gap[i]), (got[i][1], want_rms[i])):
            assert (g is None and w is None) or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9), (i, g, w)
