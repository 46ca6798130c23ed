"""Registered queries: per-zone series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators import series as SR
from tremor.operators.lagfit import MOST_LAGS, arma21, augmented_dickey_fuller
from tremor.operators.joins import dense_grid
from tremor.operators.rollup import zone_weekly
from tremor.operators.stl import robust_decompose
from tremor.plans.catalog import register
from tremor.plans.q_windows import ZONE_GRID_SQL
from tremor.plans.report import dstr, finalize, r6
from tremor.session import materialize
from tremor.sources.views import quake_long


def _zone_grid(spark, sf_dir):
    return dense_grid(zone_weekly(quake_long(spark, sf_dir)))


W = "OVER (PARTITION BY zone ORDER BY date)"
WIN = "OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING)"


@register("M14_decompose_zone", f"""{ZONE_GRID_SQL},
    t AS (SELECT date, zone, nb_seismes, (row_number() {W} - 1) % 52 AS phase,
            CASE WHEN count(nb_seismes) {WIN} = 53 THEN
              (sum(nb_seismes) {WIN} - 0.5 * (lag(nb_seismes, 26) {W} + lead(nb_seismes, 26) {W})) / 52 END AS trend
          FROM g),
    p AS (SELECT *, avg(nb_seismes - trend) OVER (PARTITION BY zone, phase) AS pm,
                 row_number() OVER (PARTITION BY zone, phase ORDER BY date) = 1 AS first_phase FROM t),
    s AS (SELECT *, pm - avg(CASE WHEN first_phase THEN pm END) OVER (PARTITION BY zone) AS seasonal FROM p)
    SELECT {dstr('date')} AS date, CAST(zone AS BIGINT) AS zone, nb_seismes, {r6('trend')} AS trend,
           {r6('seasonal')} AS seasonal, {r6('nb_seismes - trend - seasonal')} AS resid FROM s""")
def q_decompose(spark, sf_dir):
    """Classical additive decomposition (period 52) of every zone's weekly series."""
    return finalize(SR.decompose(_zone_grid(spark, sf_dir), "nb_seismes", 52, by=["zone"]))


@register("M14_robust_decompose_zone")
def q_robust_decompose(spark, sf_dir):
    """Robust seasonal-trend decomposition (period 52) of every zone's weekly
    series by local regression."""
    return finalize(robust_decompose(_zone_grid(spark, sf_dir), "nb_seismes", 52, by=["zone"]))


@register("M15_dickey_fuller", f"""{ZONE_GRID_SQL},
    d AS (SELECT zone, CAST(nb_seismes - lag(nb_seismes) {W} AS DOUBLE) AS dy, CAST(lag(nb_seismes) {W} AS DOUBLE) AS x FROM g),
    a AS (SELECT zone, regr_count(dy, x) AS n, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy, regr_sxy(dy, x) AS sxy
          FROM d GROUP BY zone)
    SELECT CAST(zone AS BIGINT) AS zone, n, {r6('sxy / sxx')} AS beta,
           {r6('(sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)')} AS df_stat,
           CAST((sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) < -2.86 AS BIGINT) AS stationary_5pct
    FROM a""")
def q_df(spark, sf_dir):
    """Dickey-Fuller statistic (constant, lag 0) per zone with the 5 % verdict."""
    return finalize(SR.dickey_fuller(_zone_grid(spark, sf_dir), by=["zone"]))


@register("M16_ar2", f"""{ZONE_GRID_SQL},
    d AS (SELECT zone, date, CAST(nb_seismes AS DOUBLE) AS y, CAST(lag(nb_seismes, 1) {W} AS DOUBLE) AS x1,
                 CAST(lag(nb_seismes, 2) {W} AS DOUBLE) AS x2 FROM g),
    l AS (SELECT zone, arg_max(y, date) AS yT, arg_max(x1, date) AS yT1 FROM d GROUP BY zone),
    s AS (SELECT zone, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2,
                 covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12,
                 covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM d WHERE x2 IS NOT NULL GROUP BY zone),
    c AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS a1,
                    (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS a2 FROM s),
    c2 AS (SELECT *, my - a1 * m1 - a2 * m2 AS c0 FROM c),
    f AS (SELECT c2.*, yT, yT1, c0 + a1 * yT + a2 * yT1 AS f1 FROM c2 JOIN l USING (zone))
    SELECT CAST(zone AS BIGINT) AS zone, n, {r6('c0')} AS c, {r6('a1')} AS a1, {r6('a2')} AS a2,
           {r6('f1')} AS f1, {r6('c0 + a1 * f1 + a2 * yT')} AS f2 FROM f""")
def q_ar2(spark, sf_dir):
    """AR(2) per zone (least squares on centred sums) and its 2-step forecast."""
    out = SR.ar2(materialize(_zone_grid(spark, sf_dir)), by=["zone"], horizon=2)
    return finalize(out.select("zone", "n", "c", "a1", "a2", F.col("forecast")[0].alias("f1"),
                               F.col("forecast")[1].alias("f2")))


def _matrix_sql(name: str, rows: str, columns: list[str], where: str, key: str = "zone") -> str:
    """CTEs ``name`` (zone, n, m): sums of products of the columns."""
    z = "[" + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in columns) + "]"
    size = len(columns) + 1
    return f"""{name}_z AS (SELECT {key}, {z} AS z FROM {rows} WHERE {where}),
    {name}_p AS (SELECT {key}, i, j, sum(z[i] * z[j]) AS v, count(*) AS n
                 FROM {name}_z, range(1, {size}) a(i), range(1, {size}) b(j) GROUP BY ALL),
    {name}_r AS (SELECT {key}, i, list(v ORDER BY j) AS r, any_value(n) AS n FROM {name}_p GROUP BY {key}, i),
    {name} AS (SELECT {key}, any_value(n) AS n, list(r ORDER BY i) AS m FROM {name}_r GROUP BY {key})"""


SWEEP_SQL = """list_transform(m, lambda r, i: CASE WHEN i = k
      THEN list_transform(r, lambda x, j: CASE WHEN j = k THEN 1.0 ELSE x END / m[k][k])
      ELSE list_transform(r, lambda x, j: CASE WHEN j = k THEN -r[k] / m[k][k] ELSE x - r[k] * m[k][j] / m[k][k] END) END)"""


def _swept_sql(name: str, source: str, last: str) -> str:
    """CTE ``name``: the matrix after each number k - 1 of swept columns."""
    return f"""{name} AS (SELECT s.*, CAST(1 AS BIGINT) AS k FROM {source} s
      UNION ALL SELECT * REPLACE ({SWEEP_SQL} AS m, k + 1 AS k) FROM {name} WHERE k <= {last})"""


_LONG = 8
_ARMA_LAGS = ", ".join(f"lag(y, {i}) OVER (PARTITION BY zone ORDER BY date) AS l{i}" for i in range(1, _LONG + 1))


@register("M16_arma21", f"""{ZONE_GRID_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)},
    y AS (SELECT zone, date, CAST(nb_seismes AS DOUBLE) AS y FROM g),
    l AS (SELECT *, {_ARMA_LAGS} FROM y),
    {_matrix_sql('one', 'l', ['1', *[f'l{i}' for i in range(1, _LONG + 1)], 'y'], f'l{_LONG} IS NOT NULL')},
    {_swept_sql('s1', 'one', str(_LONG + 1))},
    co AS (SELECT zone, list_transform(m, lambda r: r[-1]) AS b FROM s1 WHERE k = {_LONG + 2}),
    e AS (SELECT l.zone, date, y, l1, l2, CASE WHEN l{_LONG} IS NOT NULL THEN y - (b[1] + {' + '.join(f'b[{i + 1}] * l{i}' for i in range(1, _LONG + 1))}) END AS e
          FROM l JOIN co USING (zone)),
    f AS (SELECT *, lag(e) OVER (PARTITION BY zone ORDER BY date) AS e1 FROM e),
    {_matrix_sql('two', 'f', ['1', 'l1', 'l2', 'e1', 'y'], 'e1 IS NOT NULL')},
    {_swept_sql('s2', 'two', '4')},
    c AS (SELECT zone, n, m[1][5] AS c, m[2][5] AS a1, m[3][5] AS a2, m[4][5] AS b1 FROM s2 WHERE k = 5),
    t AS (SELECT zone, arg_max(y, date) AS y0, arg_max(l1, date) AS y1, arg_max(l2, date) AS y2, arg_max(e1, date) AS e1 FROM f GROUP BY zone),
    o AS (SELECT *, c + a1 * y0 + a2 * y1 + b1 * (y0 - (c + a1 * y1 + a2 * y2 + b1 * e1)) AS f1 FROM c JOIN t USING (zone))
    SELECT CAST(zone AS BIGINT) AS zone, n, {r6('c', 4)} AS c, {r6('a1', 4)} AS a1, {r6('a2', 4)} AS a2, {r6('b1', 4)} AS b1, {r6('f1', 4)} AS f1,
           {r6('c + a1 * f1 + a2 * y0', 4)} AS f2 FROM o""")
def q_arma21(spark, sf_dir):
    """ARMA(2, 1) per zone by two regression stages, and its 2-step forecast."""
    out = arma21(materialize(_zone_grid(spark, sf_dir)), by=["zone"], long_lags=_LONG, horizon=2)
    return finalize(out.select("zone", "n", "c", "a1", "a2", "b1", F.col("forecast")[0].alias("f1"), F.col("forecast")[1].alias("f2")), 4)


_ADF = [f"d{i}" for i in range(1, MOST_LAGS + 1)]


@register("M15_augmented_dickey_fuller", f"""{ZONE_GRID_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)},
    y0 AS (SELECT zone, date, CAST(nb_seismes AS DOUBLE) AS y, lag(CAST(nb_seismes AS DOUBLE)) {W} AS x, row_number() {W} AS rn,
                  count(*) OVER (PARTITION BY zone) AS len FROM g),
    y1 AS (SELECT *, y - x AS dy, CAST(greatest(least(ceil(12 * pow(len / 100, 0.25)), len // 2 - 2, {MOST_LAGS}), 0) AS BIGINT) AS lim FROM y0),
    l AS (SELECT *, {', '.join(f'lag(dy, {i}) OVER (PARTITION BY zone ORDER BY date) AS d{i}' for i in range(1, MOST_LAGS + 1))} FROM y1),
    {_matrix_sql('cm', 'l', ['1', 'x', *_ADF, 'dy'], 'rn > lim + 1', 'zone, lim')},
    {_swept_sql('s1', 'cm', 'lim + 2')},
    aic AS (SELECT zone, k - 3 AS p, n * ln(m[-1][-1]) + 2 * (k - 1) AS aic FROM s1 WHERE k >= 3),
    best AS (SELECT zone, arg_min(p, aic) AS used_lag FROM aic GROUP BY zone),
    f AS (SELECT zone, rn, y, x, dy, used_lag, {', '.join(f'CASE WHEN used_lag >= {i} THEN d{i} END AS d{i}' for i in range(1, MOST_LAGS + 1))}
          FROM l JOIN best USING (zone)),
    {_matrix_sql('fm', 'f', ['1', 'x', *_ADF, 'dy'], 'rn > used_lag + 1', 'zone, used_lag')},
    {_swept_sql('s2', 'fm', 'used_lag + 2')},
    o AS (SELECT zone, used_lag, n, m[2][-1] / sqrt(m[-1][-1] / (n - used_lag - 2) * m[2][2]) AS t,
                 -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n) AS crit FROM s2 WHERE k = used_lag + 3)
    SELECT CAST(zone AS BIGINT) AS zone, n, used_lag, {r6('t', 4)} AS adf_stat, {r6('crit', 4)} AS crit_5pct, CAST(t < crit AS BIGINT) AS stationary_5pct FROM o""")
def q_adf(spark, sf_dir):
    """Augmented unit-root test per zone, lags by AIC, with the 5 % verdict."""
    return finalize(augmented_dickey_fuller(materialize(_zone_grid(spark, sf_dir)), by=["zone"]), 4)


@register("A21_pacf_zone", f"""{ZONE_GRID_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)},
    c AS (SELECT zone, date, nb_seismes - avg(nb_seismes) OVER (PARTITION BY zone) AS d FROM g),
    l AS (SELECT zone, d, {', '.join(f'lag(d, {k}) {W} AS l{k}' for k in range(1, 61))} FROM c),
    r AS (SELECT zone, [1.0, {', '.join(f'sum(d * l{k}) / sum(d * d)' for k in range(1, 61))}] AS r FROM l GROUP BY zone),
    p AS (SELECT zone, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1.0 AS DOUBLE) AS v, CAST(1.0 AS DOUBLE) AS pacf FROM r
      UNION ALL
      SELECT zone, r, k + 1, list_concat(list_transform(phi, lambda x, j: x - q * phi[len(phi) + 1 - j]), [q]), v * (1 - q * q), q
      FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(phi, lambda x, j: x * r[k + 2 - j])), 0)) / v AS q FROM p WHERE k < 60))
    SELECT CAST(zone AS BIGINT) AS zone, CAST(k AS BIGINT) AS lag, {r6('pacf')} AS pacf FROM p""")
def q_pacf(spark, sf_dir):
    """Partial autocorrelation (lags 0..60) of every zone's weekly series."""
    return finalize(SR.pacf(_zone_grid(spark, sf_dir), "nb_seismes", 60, by=["zone"]))


_HW_POINTS = ", ".join(f"({a}, {b}, {g})" for a in SR.HW_GRID["alpha"] for b in SR.HW_GRID["beta"] for g in SR.HW_GRID["gamma"])


@register("M17_holt_winters_zone", f"""{ZONE_GRID_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)},
    x AS (SELECT zone, list(CAST(nb_seismes AS DOUBLE) ORDER BY date) AS x, count(*) AS n FROM g GROUP BY zone),
    p(a, b, c) AS (VALUES {_HW_POINTS}),
    i AS (SELECT zone, n, x, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, list_sum(x[1:52]) / 52 AS lv FROM x, p WHERE n >= 104),
    w AS (SELECT zone, n, x, a, b, c, CAST(1 AS BIGINT) AS t, CAST(lv AS DOUBLE) AS level, CAST((list_sum(x[53:104]) / 52 - lv) / 52 AS DOUBLE) AS trend,
                 list_transform(x[1:52], lambda v: v - lv) AS season, CAST(0.0 AS DOUBLE) AS sse FROM i
      UNION ALL
      SELECT zone, n, x, a, b, c, t + 1, nl, b * (nl - level) + (1 - b) * trend, list_concat(season[2:52], [c * (x[t] - nl) + (1 - c) * season[1]]),
             sse + (x[t] - (level + trend + season[1])) * (x[t] - (level + trend + season[1]))
      FROM (SELECT *, a * (x[t] - season[1]) + (1 - a) * (level + trend) AS nl FROM w WHERE t <= n)),
    f AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY sse, a, b, c) AS place FROM w WHERE t = n + 1)
    SELECT CAST(zone AS BIGINT) AS zone, n, {r6('a', 4)} AS alpha, {r6('b', 4)} AS beta, {r6('c', 4)} AS gamma, {r6('sse', 4)} AS sse,
           {', '.join(r6(f'level + {h} * trend + season[{h}]', 4) + f' AS f{h}' for h in range(1, 5))} FROM f WHERE place = 1""")
def q_hw(spark, sf_dir):
    """Additive Holt-Winters (period 52) per zone, smoothing chosen on a grid
    by in-sample SSE: 4-week forecast."""
    out = SR.holt_winters(_zone_grid(spark, sf_dir), "nb_seismes", 52, by=["zone"], horizon=4, optimize=True)
    return finalize(out.select("zone", "n", "alpha", "beta", "gamma", "sse", *[F.col("forecast")[h].alias(f"f{h + 1}") for h in range(4)]), 4)
