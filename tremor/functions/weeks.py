"""Calendar-week labels and bounds.

Three labelling conventions occur in the reference and are kept apart:

* ``w_mon_close`` — Tuesday..Monday bins labelled by the closing Monday
  (the notebook's weekly resample);
* ``iso_start``   — Monday..Sunday labelled by the starting Monday
  (the zones job);
* ``iso_end``     — Monday..Sunday labelled by the closing Sunday
  (the forecast job).

All are plain column expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_MODES = ("w_mon_close", "iso_start", "iso_end")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def week_label(col, mode: str = "w_mon_close") -> Column:
    """Date label of the week a timestamp/date falls in."""
    d = F.to_date(_c(col))
    if mode == "w_mon_close":
        return F.next_day(F.date_sub(d, 1), "Mon")
    if mode == "iso_start":
        return F.to_date(F.date_trunc("week", d))
    if mode == "iso_end":
        return F.date_add(F.to_date(F.date_trunc("week", d)), 6)
    raise ValueError(f"week mode must be one of {WEEK_MODES}")


def week_label_sql(expr: str, mode: str = "w_mon_close") -> str:
    """DuckDB form of :func:`week_label` (for oracle SQL)."""
    if mode == "w_mon_close":
        return f"(CAST(date_trunc('week', CAST({expr} AS DATE) - 1) AS DATE) + 7)"
    if mode == "iso_start":
        return f"CAST(date_trunc('week', CAST({expr} AS DATE)) AS DATE)"
    if mode == "iso_end":
        return f"(CAST(date_trunc('week', CAST({expr} AS DATE)) AS DATE) + 6)"
    raise ValueError(mode)


def week_bounds(ts) -> tuple[Column, Column]:
    """(Monday 00:00:00, Sunday 23:59:59) of the week containing ``ts``."""
    start = F.date_trunc("week", _c(ts))
    end = start + F.expr("INTERVAL 6 DAYS 23 HOURS 59 MINUTES 59 SECONDS")
    return start, end


def next_week_start(ts) -> Column:
    """Start of the following week."""
    return F.date_add(F.to_date(F.date_trunc("week", _c(ts))), 7)


def iso_week(col) -> Column:
    """ISO week number (P11); 2024-12-30 -> 1, 2021-01-03 -> 53."""
    return F.weekofyear(_c(col))
