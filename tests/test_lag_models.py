"""M14 (robust), M15 (augmented), M16 (ARMA), M17: against plain versions."""

import math

import numpy as np
import pytest

from tremor.operators.lagfit import arma21, augmented_dickey_fuller
from tremor.operators.stl import robust_decompose


def frame(spark, series):
    return spark.createDataFrame([(z, i, float(v)) for z, y in series.items() for i, v in enumerate(y)], "zone string, date int, nb_seismes double")


def walk(seed, n, share):
    rng = np.random.default_rng(seed)
    y = [0.0, 0.0]
    for e in rng.normal(0, 1, n):
        y.append(y[-1] * share + 0.3 * (y[-1] - y[-2]) + e)
    return np.array(y[2:])


def plain_adf(y):
    n = len(y)
    limit = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(y)

    def fit(lags, first):
        rows = range(first, len(d))
        x = np.array([[1, y[t], *[d[t - i] for i in range(1, lags + 1)]] for t in rows])
        z = d[list(rows)]
        coef = np.linalg.lstsq(x, z, rcond=None)[0]
        sse = ((z - x @ coef) ** 2).sum()
        return len(z), sse, coef[1] / math.sqrt(sse / (len(z) - lags - 2) * np.linalg.inv(x.T @ x)[1, 1])

    scored = [(m * math.log(sse) + 2 * (p + 2), p) for p in range(limit + 1) for m, sse, _ in [fit(p, limit)]]
    lag = min(scored)[1]
    return lag, *fit(lag, lag)[::2]


def test_augmented_test_equals_plain_regressions(spark):
    series = {"a": walk(1, 150, 1.0), "b": walk(2, 150, 0.6), "c": walk(3, 90, 0.95), "flat": np.full(60, 4.0), "short": np.array([1.0, 2.0, 4.0])}
    got = {r.zone: r for r in augmented_dickey_fuller(frame(spark, series), by=["zone"]).collect()}
    for z in "abc":
        lag, n, stat = plain_adf(series[z])
        assert (got[z].used_lag, got[z].n) == (lag, n) and got[z].adf_stat == pytest.approx(stat, rel=1e-7)
        assert got[z].stationary_5pct == (stat < got[z].crit_5pct) and -3.1 < got[z].crit_5pct < -2.85
    assert {got[z].used_lag for z in "abc"} != {0} and got["b"].stationary_5pct and not got["a"].stationary_5pct
    assert got["flat"].adf_stat is None and got["short"].adf_stat is None
    one = augmented_dickey_fuller(frame(spark, {"a": series["a"]}).drop("zone")).first()
    assert one.adf_stat == pytest.approx(got["a"].adf_stat)


def test_arma_equals_two_plain_regressions(spark):
    rng = np.random.default_rng(4)
    series = {}
    for z, b in (("a", 0.5), ("b", -0.4)):
        y, last = [0.0, 0.0], 0.0
        for e in rng.normal(0, 1, 2500):
            y.append(2 + 0.5 * y[-1] + 0.2 * y[-2] + e + b * last)
            last = e
        series[z] = np.array(y[2:])
    series["flat"] = np.full(40, 3.0)
    got = {r.zone: r for r in arma21(frame(spark, series), by=["zone"], horizon=3).collect()}
    for z, b in (("a", 0.5), ("b", -0.4)):
        y = series[z]
        t = np.arange(8, len(y))
        x = np.column_stack([np.ones(len(t)), *[y[t - i] for i in range(1, 9)]])
        e = y[t] - x @ np.linalg.lstsq(x, y[t], rcond=None)[0]
        t2 = t[1:]
        x2 = np.column_stack([np.ones(len(t2)), y[t2 - 1], y[t2 - 2], e[:-1]])
        coef = np.linalg.lstsq(x2, y[t2], rcond=None)[0]
        r = got[z]
        assert np.allclose([r.c, r.a1, r.a2, r.b1], coef, rtol=1e-6) and r.n == len(t2)
        assert abs(r.b1 - b) < 0.15 and abs(r.a1 - 0.5) < 0.15           # near the truth
        newest = y[-1] - np.array([1, y[-2], y[-3], e[-2]]) @ coef
        f1 = np.array([1, y[-1], y[-2], newest]) @ coef
        f2 = coef[0] + coef[1] * f1 + coef[2] * y[-1]
        assert np.allclose(r.forecast, [f1, f2, coef[0] + coef[1] * f2 + coef[2] * f1], rtol=1e-6)
    assert got["flat"].a1 is None


def plain_line(y, width, weight, at):
    """One local line, point by point."""
    n = len(y)
    reach = min(width, n)
    first = min(max(int(np.round(at)) - (reach - 1) // 2, 0), n - reach)
    xs = range(first, first + reach)
    far = max(abs(first - at), abs(first + reach - 1 - at)) + max(0, (width - n) // 2)
    w = []
    for x in xs:
        g = abs(x - at)
        w.append((1.0 if g <= 0.001 * far else (1 - (g / far) ** 3) ** 3 if g <= 0.999 * far else 0.0) * weight[x])
    total = sum(w)
    if not total:
        return None
    w = [v / total for v in w]
    middle = sum(v * x for v, x in zip(w, xs))
    spread = sum(v * (x - middle) ** 2 for v, x in zip(w, xs))
    value = sum(v * y[x] for v, x in zip(w, xs))
    if math.sqrt(spread) > 0.001 * (n - 1):
        value += (at - middle) / spread * sum(v * (x - middle) * y[x] for v, x in zip(w, xs))
    return value


def plain_stl(y, period, outer):
    n = len(y)
    odd = lambda x: math.ceil(x) + 1 - math.ceil(x) % 2
    trend, weight = [0.0] * n, [1.0] * n
    for k in range(outer):
        for _ in range(2):
            cycle = [0.0] * (n + 2 * period)
            for phase in range(period):
                own = list(range(phase, n, period))
                rest = [y[i] - trend[i] for i in own]
                for m in range(-1, len(own) + 1):
                    v = plain_line(rest, 7, [weight[i] for i in own], m)
                    cycle[(m + 1) * period + phase] = v if v is not None else rest[min(max(m, 0), len(own) - 1)]
            low = cycle
            for width in (period, period, 3):
                low = [sum(low[i:i + width]) / width for i in range(len(low) - width + 1)]
            season = [cycle[period + i] - plain_line(low, odd(period + 1), [1.0] * n, i) for i in range(n)]
            rest = [y[i] - season[i] for i in range(n)]
            trend = [v if (v := plain_line(rest, odd(1.5 * period / (1 - 1.5 / 7)), weight, i)) is not None else rest[i] for i in range(n)]
        gap = [abs(y[i] - season[i] - trend[i]) for i in range(n)]
        scale = 6 * float(np.median(gap))
        weight_next = [1.0 if g <= 0.001 * scale else (1 - (g / scale) ** 2) ** 2 if g <= 0.999 * scale else 0.0 for g in gap]
        if k < outer - 1:
            weight = weight_next
    return season, trend


def test_robust_decomposition_equals_plain_loops_and_leaves_outliers_in_the_rest(spark):
    rng = np.random.default_rng(8)
    n, period = 74, 12
    t = np.arange(n)
    clean = 50 + 0.3 * t + 8 * np.sin(2 * np.pi * t / period) + rng.normal(0, 0.5, n)
    hit = clean.copy()
    hit[31] += 60
    got = {}
    for r in robust_decompose(frame(spark, {"clean": clean, "hit": hit, "short": clean[:20]}), period=period, by=["zone"]).collect():
        got.setdefault(r.zone, {})[r.date] = r
    for z, y in (("clean", clean), ("hit", hit)):
        season, trend = plain_stl(list(y), period, 15)
        assert np.allclose([got[z][i].seasonal for i in range(n)], season, atol=1e-8)
        assert np.allclose([got[z][i].trend for i in range(n)], trend, atol=1e-8)
        assert all(got[z][i].resid == pytest.approx(y[i] - got[z][i].seasonal - got[z][i].trend) for i in range(n))
    assert got["hit"][31].resid > 55 and got["hit"][31].weight == 0
    moved = max(abs(got["hit"][i].seasonal + got["hit"][i].trend - got["clean"][i].seasonal - got["clean"][i].trend) for i in range(n))
    assert moved < 2
    loose = {r.date: r for r in robust_decompose(frame(spark, {"hit": hit}).drop("zone"), period=period, robust=False).collect()}
    assert loose[31].resid < 50                                     # without the weights the outlier bends the season
    assert all(r.trend is None and r.nb_seismes is not None for r in got["short"].values())


def test_holt_winters_fold_equals_a_plain_loop(spark):
    from tremor.operators.series import HW_GRID, holt_winters
    rng = np.random.default_rng(3)
    period, n = 4, 30
    series = {z: 20 + 0.2 * np.arange(n) + 3 * np.sin(np.arange(n) * np.pi / 2) + rng.normal(0, 1, n) for z in "ab"}

    def run(x, a, b, g):
        level, trend, season, sse = x[:4].mean(), (x[4:8].mean() - x[:4].mean()) / 4, list(x[:4] - x[:4].mean()), 0.0
        for t, v in enumerate(x):
            s = season[t % 4]
            sse += (v - level - trend - s) ** 2
            new = a * (v - s) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            season[t % 4] = g * (v - new) + (1 - g) * s
            level = new
        return sse, a, b, g, [level + h * trend + season[(n + h - 1) % 4] for h in (1, 2, 3, 4, 5, 6)]

    got = {r.zone: r for r in holt_winters(frame(spark, series | {"short": [1.0] * 7}), period=period, by=["zone"], horizon=6, optimize=True).collect()}
    for z in "ab":
        want = min(run(series[z], a, b, g) for a in HW_GRID["alpha"] for b in HW_GRID["beta"] for g in HW_GRID["gamma"])
        assert got[z].sse == pytest.approx(want[0]) and (got[z].alpha, got[z].beta, got[z].gamma) == want[1:4]
        assert got[z].forecast == pytest.approx(want[4])
    assert got["short"].sse is None and got["short"].forecast == [] and got["short"].n == 7
