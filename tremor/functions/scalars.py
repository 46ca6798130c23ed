"""Scalar column functions.

Each helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays JVM-side and inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_ms(col) -> Column:
    """Epoch milliseconds -> timestamp (session time zone is UTC)."""
    return F.timestamp_millis(_c(col).cast("bigint"))


def try_ts(col, fmt: str | None = None) -> Column:
    """Coercing timestamp parse, bad text -> NULL."""
    c = _c(col).cast("string")
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def to_day(col) -> Column:
    """P5: timestamp -> date."""
    return F.to_date(_c(col))


def time_parts(ts) -> dict[str, Column]:
    """P10: hour, day of week with Monday = 0, month, quarter, year."""
    t = _c(ts)
    return {
        "hour": F.hour(t),
        "dayofweek": F.weekday(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
        "year": F.year(t),
    }


def cyclic(col, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*c/period."""
    angle = F.lit(2 * math.pi) * _c(col) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def log1p0(col) -> Column:
    """log1p with NULL treated as 0."""
    return F.log1p(F.coalesce(_c(col).cast("double"), F.lit(0.0)))


def energy(mag, null_as_zero: bool = False) -> Column:
    """Released-energy proxy 10^(1.5*mag).

    The notebook leaves a NULL magnitude out of the sum (default); the
    serving job counts it as magnitude 0, i.e. energy 1 (``null_as_zero``).
    """
    m = _c(mag)
    if null_as_zero:
        m = F.coalesce(m, F.lit(0.0))
    return F.pow(F.lit(10.0), F.lit(1.5) * m)


def ratio1(num, den) -> Column:
    """Smoothed ratio num / (den + 1)."""
    return _c(num) / (_c(den) + F.lit(1))


def nonneg_int(col) -> Column:
    """Clamp at 0 and truncate toward zero."""
    return F.greatest(_c(col), F.lit(0)).cast("int")


def winsorise(col, lo, hi) -> Column:
    """Clip to [lo, hi] (bounds may be columns or literals)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(_c(col), lo_c), hi_c)


def pct(col, digits: int = 1) -> Column:
    """Probability -> percent, rounded half-up."""
    return F.round(_c(col) * F.lit(100.0), digits)


def safe_pct(num, den) -> Column:
    """Percent change num/den*100, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(_c(num).cast("double") * F.lit(100.0), _c(den)), F.lit(0.0))


def safe_div(num, den) -> Column:
    """Guarded division, 0 when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den)), F.lit(0.0))


def inf_to_null(col) -> Column:
    """+-inf -> NULL."""
    c = _c(col)
    return F.when(F.abs(c) == F.lit(float("inf")), F.lit(None).cast("double")).otherwise(c)


def fmt_date(col) -> Column:
    """Yyyy-MM-dd text."""
    return F.date_format(_c(col), "yyyy-MM-dd")


def fmt_change(diff, pct_col) -> Column:
    """Signed change text '+12 (+3.4%)' as the weekly report prints it."""
    return F.format_string("%+d (%+.1f%%)", _c(diff).cast("int"), _c(pct_col).cast("double"))
