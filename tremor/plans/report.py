"""Report normalisation shared by registered queries and their SQL twins.

Registered queries end in :func:`finalize`: dates and timestamps become
ISO text, doubles are rounded to 6 decimals (``+ 0.0`` folds -0.0), and
integral columns are widened to bigint.  The SQL helpers produce the same
normalisation in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.BooleanType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(out)


# ---- DuckDB twins -------------------------------------------------------

def r6(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def dstr(expr: str) -> str:
    return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d')"


def tstr(expr: str) -> str:
    return f"strftime(CAST({expr} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
