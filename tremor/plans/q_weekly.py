"""Registered queries: weekly series and features (flagship, A1, A3, J4, W1-W7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.plans.catalog import register
from tremor.plans.report import big, dstr, finalize, r6
from tremor.plans.sqlparts import WITH_LONG, filled_weekly_sql, roll_sql, weekly_rollup_sql
from tremor.plans.weekly import (COUNT_LAGS, ENERGY_LAGS, ENERGY_ROLL, ROLL_MAX, ROLL_MEAN,
                                 ROLL_STD, ZONE_LAGS, weekly_features, weekly_series)
from tremor.operators.rollup import weekly_rollup
from tremor.sources.views import quake_long

# Energy sums reach 1e15: their last digits depend on summation order, so
# reports carry them on a log1p scale.
ENERGY_COLS = (["energy_sum", "energy_per_seisme"] + [f"energy_lag_{k}" for k in ENERGY_LAGS]
               + [f"energy_rolling_{n}" for n in ENERGY_ROLL])


def log_energy_report(df: DataFrame) -> DataFrame:
    present = [c for c in ENERGY_COLS if c in df.columns]
    return df.withColumns({c: F.log1p(c) for c in present}).withColumnsRenamed(
        {c: f"log1p_{c}" for c in present})


def weekly_feature_table(spark, sf_dir) -> DataFrame:
    """Flagship: quake_long -> weekly rollup -> gap fill -> all weekly features."""
    return finalize(log_energy_report(weekly_features(quake_long(spark, sf_dir))))


def _feature_sql(log_energy: bool = True, name: str = "feat", future_row: bool = False, part: str = "") -> str:
    """DuckDB twin of the feature table; energy columns log1p-scaled or raw.
    ``future_row`` appends next week's label with unknown measures first;
    ``part`` makes one series per key."""
    w = f"OVER (PARTITION BY {part} ORDER BY date)" if part else "OVER (ORDER BY date)"
    L, P = (("ln(1 + ", ")"), "log1p_") if log_energy else (("(", ")"), "")
    cols = ([part] if part else []) + ["date", "nb_seismes", "tsunami_sum", "nb_zones", "mag_max", "mag_mean",
                                       "mag_median", "depth_mean", f"{L[0]}energy_sum{L[1]} AS {P}energy_sum"]
    cols += [f"CAST(lag(nb_seismes, {k}) {w} AS DOUBLE) AS lag_{k}" for k in COUNT_LAGS]
    cols += [f"{L[0]}lag(energy_sum, {k}) {w}{L[1]} AS {P}energy_lag_{k}" for k in ENERGY_LAGS]
    cols += [f"CAST(lag(nb_zones, {k}) {w} AS DOUBLE) AS zones_lag_{k}" for k in ZONE_LAGS]
    cols += [f"{roll_sql('nb_seismes', n, 'avg', part=part)} AS rolling_mean_{n}" for n in ROLL_MEAN]
    cols += [f"{roll_sql('nb_seismes', n, 'stddev_samp', part=part)} AS rolling_std_{n}" for n in ROLL_STD]
    cols += [f"CAST({roll_sql('nb_seismes', n, 'max', part=part)} AS DOUBLE) AS rolling_max_{n}" for n in ROLL_MAX]
    cols += [f"{L[0]}{roll_sql('energy_sum', n, 'avg', part=part)}{L[1]} AS {P}energy_rolling_{n}" for n in ENERGY_ROLL]
    cols += ["weekofyear(date) AS week_of_year", "month(date) AS month", "quarter(date) AS quarter",
             "year(date) AS year",
             "sin(2 * pi() * weekofyear(date) / 52.0) AS week_sin",
             "cos(2 * pi() * weekofyear(date) / 52.0) AS week_cos",
             "sin(2 * pi() * month(date) / 12.0) AS month_sin",
             "cos(2 * pi() * month(date) / 12.0) AS month_cos",
             f"{L[0]}energy_sum / (nb_seismes + 1){L[1]} AS {P}energy_per_seisme",
             "tsunami_sum / (nb_seismes + 1) AS tsunami_ratio",
             "mag_max - mag_mean AS mag_spread",
             f"CAST(nb_seismes - lag(nb_seismes, 1) {w} AS DOUBLE) AS delta_seismes",
             "ln(1 + energy_sum) AS log_energy"]
    src = "filled"
    extra = ""
    if future_row:
        src = "filled_next"
        extra = (", filled_next AS (SELECT date, nb_seismes, tsunami_sum, nb_zones, energy_sum, mag_max, mag_mean,"
                 " mag_median, depth_mean FROM filled UNION ALL SELECT max(date) + 7, NULL, NULL, NULL, NULL, NULL,"
                 " NULL, NULL, NULL FROM filled)")
    return f"{WITH_LONG}, {filled_weekly_sql(part=part)}{extra}, {name} AS (SELECT {', '.join(cols)} FROM {src})"


def _final_sql(cte_tail: str, types: dict[str, str]) -> str:
    sel = []
    for c, t in types.items():
        sel.append({"d": dstr(c), "f": r6(c), "i": big(c), "s": c}[t] + f" AS {c}")
    return f"{cte_tail} SELECT {', '.join(sel)} FROM feat"


_FEATURE_TYPES = {"date": "d", "nb_seismes": "i", "tsunami_sum": "i", "nb_zones": "i",
                  "mag_max": "f", "mag_mean": "f", "mag_median": "f", "depth_mean": "f",
                  "log1p_energy_sum": "f"}
_FEATURE_TYPES.update({f"lag_{k}": "f" for k in COUNT_LAGS})
_FEATURE_TYPES.update({f"log1p_energy_lag_{k}": "f" for k in ENERGY_LAGS})
_FEATURE_TYPES.update({f"zones_lag_{k}": "f" for k in ZONE_LAGS})
_FEATURE_TYPES.update({f"rolling_mean_{n}": "f" for n in ROLL_MEAN})
_FEATURE_TYPES.update({f"rolling_std_{n}": "f" for n in ROLL_STD})
_FEATURE_TYPES.update({f"rolling_max_{n}": "f" for n in ROLL_MAX})
_FEATURE_TYPES.update({f"log1p_energy_rolling_{n}": "f" for n in ENERGY_ROLL})
_FEATURE_TYPES.update({"week_of_year": "i", "month": "i", "quarter": "i", "year": "i",
                       "week_sin": "f", "week_cos": "f", "month_sin": "f", "month_cos": "f",
                       "log1p_energy_per_seisme": "f", "tsunami_ratio": "f", "mag_spread": "f",
                       "delta_seismes": "f", "log_energy": "f"})

FLAGSHIP_SQL = _final_sql(_feature_sql(), _FEATURE_TYPES)
register("weekly_features", FLAGSHIP_SQL)(weekly_feature_table)


@register("A1_weekly_rollup", f"""{WITH_LONG}, w AS ({weekly_rollup_sql()})
    SELECT {dstr('date')} AS date, nb_seismes, {r6('mag_max')} AS mag_max, {r6('mag_mean')} AS mag_mean,
           {r6('mag_median')} AS mag_median, {r6('depth_mean')} AS depth_mean, tsunami_sum, nb_zones,
           {r6('ln(1 + energy_sum)')} AS log1p_energy_sum FROM w""")
def q_weekly_rollup(spark, sf_dir):
    """A1+A3: raw weekly rollup (W-MON closing-Monday labels), no gap fill."""
    return finalize(log_energy_report(weekly_rollup(quake_long(spark, sf_dir))))


@register("A1_weekly_rollup_iso_start", f"""{WITH_LONG}, w AS ({weekly_rollup_sql(mode='iso_start')})
    SELECT {dstr('date')} AS date, nb_seismes, {r6('mag_max')} AS mag_max, {r6('mag_mean')} AS mag_mean,
           {r6('mag_median')} AS mag_median, {r6('depth_mean')} AS depth_mean, tsunami_sum, nb_zones,
           {r6('ln(1 + energy_sum)')} AS log1p_energy_sum FROM w""")
def q_weekly_rollup_iso(spark, sf_dir):
    """A1 with Monday-start labels (zones-job convention, SURVEY D1)."""
    return finalize(log_energy_report(weekly_rollup(quake_long(spark, sf_dir), mode="iso_start")))


@register("J4_fill_weeks", f"""{WITH_LONG}, {filled_weekly_sql()}
    SELECT {dstr('date')} AS date, nb_seismes, tsunami_sum, nb_zones, {r6('mag_max')} AS mag_max,
           {r6('mag_mean')} AS mag_mean, {r6('mag_median')} AS mag_median,
           {r6('depth_mean')} AS depth_mean, {r6('ln(1 + energy_sum)')} AS log1p_energy_sum FROM filled""")
def q_fill_weeks(spark, sf_dir):
    """J4 + W14: gap-free weekly series, zeros for counts, interpolated magnitudes."""
    return finalize(log_energy_report(weekly_series(quake_long(spark, sf_dir))))


@register("W12_next_features_consistent", _final_sql(_feature_sql(future_row=True), _FEATURE_TYPES).replace(
    " FROM feat", " FROM (SELECT * FROM feat ORDER BY date DESC LIMIT 1)"))
def q_next_consistent(spark, sf_dir):
    """Next-week feature row built by appending next week's label (unknown
    measures) and running the same feature code as for training rows, so
    lags and rolling windows include the newest week (SURVEY D8)."""
    from tremor.plans.weekly import next_features_consistent
    return finalize(log_energy_report(next_features_consistent(weekly_series(quake_long(spark, sf_dir)))))


@register("A1_weekly_rollup_refined_median", f"""{WITH_LONG}, w AS ({weekly_rollup_sql()})
    SELECT {dstr('date')} AS date, nb_seismes, {r6('mag_max')} AS mag_max, {r6('mag_mean')} AS mag_mean,
           {r6('mag_median')} AS mag_median, {r6('depth_mean')} AS depth_mean, tsunami_sum, nb_zones,
           {r6('ln(1 + energy_sum)')} AS log1p_energy_sum FROM w""")
def q_weekly_rollup_refined(spark, sf_dir):
    """A1 with the bounded-memory exact median (histogram refinement)."""
    return finalize(log_energy_report(weekly_rollup(quake_long(spark, sf_dir), exact_median=True)))


_ZONE_TYPES = {"zone": "i", **_FEATURE_TYPES}


@register("A1_J4_W1_zone_weekly_features", _final_sql(_feature_sql(part="zone"), _ZONE_TYPES))
def q_zone_weekly_features(spark, sf_dir):
    """The full weekly feature table for every zone at once: rollup by (week,
    zone), each zone's own gap-free span, every window partitioned by zone."""
    return finalize(log_energy_report(weekly_features(quake_long(spark, sf_dir), by=["zone"])))
