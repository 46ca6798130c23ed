"""Reusable DuckDB fragments for the oracle SQL (independent of Spark code)."""

from __future__ import annotations

from tremor.functions.weeks import week_label_sql
from tremor.sources.views import QUAKE_LONG_SQL, QUAKE_SQL

WITH_QUAKE = "WITH " + QUAKE_SQL
WITH_LONG = "WITH " + QUAKE_LONG_SQL
WITH_BOTH = "WITH " + QUAKE_SQL + ", " + QUAKE_LONG_SQL


def wk(expr: str = "time_utc", mode: str = "w_mon_close") -> str:
    return week_label_sql(expr, mode)


def weekly_rollup_sql(src: str = "quake_long", mode: str = "w_mon_close", part: str = "") -> str:
    key = f", {part}" if part else ""
    return f"""SELECT {wk('time_utc', mode)} AS date{key},
        count(id) AS nb_seismes, max(mag) AS mag_max, avg(mag) AS mag_mean,
        median(mag) AS mag_median, avg(depth_km) AS depth_mean,
        CAST(sum(tsunami) AS BIGINT) AS tsunami_sum, count(DISTINCT place) AS nb_zones,
        sum(pow(10.0, 1.5 * mag)) AS energy_sum
      FROM {src} WHERE time_utc IS NOT NULL GROUP BY 1{key}"""


def spine_sql(src: str, date: str = "date") -> str:
    return (f"SELECT CAST(unnest(generate_series(CAST(min({date}) AS TIMESTAMP), "
            f"CAST(max({date}) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS {date} FROM {src}")


def interp_sql(c: str, rn: str = "rn") -> str:
    """Linear interpolation over row positions; needs WINDOW bef, aft."""
    pv = f"last_value({c} IGNORE NULLS) OVER bef"
    pi = f"last_value(CASE WHEN {c} IS NOT NULL THEN {rn} END IGNORE NULLS) OVER bef"
    nv = f"first_value({c} IGNORE NULLS) OVER aft"
    ni = f"first_value(CASE WHEN {c} IS NOT NULL THEN {rn} END IGNORE NULLS) OVER aft"
    return (f"coalesce({c}, CASE WHEN {nv} IS NULL THEN {pv} "
            f"ELSE {pv} + ({nv} - {pv}) * ({rn} - {pi}) / ({ni} - {pi}) END)")


def filled_weekly_sql(src: str = "quake_long", part: str = "") -> str:
    """CTE body list: wk (rollup), sp (spine), f0 (joined), filled (interpolated);
    with ``part`` one series per key, each from its own first to last week."""
    ic = ["mag_max", "mag_mean", "mag_median", "depth_mean"]
    pk = f"{part}, " if part else ""
    pby = f"PARTITION BY {part} " if part else ""
    if part:
        spine = (f"SELECT {part}, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), "
                 f"CAST(max(date) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS date FROM wk GROUP BY {part}")
        on = f"sp.date = wk.date AND sp.{part} = wk.{part}"
        spk = f"sp.{part}, "
    else:
        spine, on, spk = spine_sql('wk'), "sp.date = wk.date", ""
    return f"""wk AS ({weekly_rollup_sql(src, part=part)}),
    sp AS ({spine}),
    f0 AS (SELECT {spk}sp.date, coalesce(nb_seismes, 0) AS nb_seismes, mag_max, mag_mean, mag_median,
                  depth_mean, coalesce(tsunami_sum, 0) AS tsunami_sum, coalesce(nb_zones, 0) AS nb_zones,
                  coalesce(energy_sum, 0) AS energy_sum, row_number() OVER ({pby.replace(part, 'sp.' + part) if part else ''}ORDER BY sp.date) AS rn
           FROM sp LEFT JOIN wk ON {on}),
    filled AS (SELECT {pk}date, nb_seismes, tsunami_sum, nb_zones, energy_sum, rn,
                  {', '.join(interp_sql(c) + ' AS ' + c for c in ic)}
           FROM f0
           WINDOW bef AS ({pby}ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  aft AS ({pby}ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def roll_sql(c: str, n: int, fn: str, order: str = "date", part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    frame = f"OVER ({p}ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN {fn}({c}) {frame} END"
