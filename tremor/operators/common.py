"""Shared helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach every column of a one-row aggregate to each row of ``df``.

    The row travels as ONE scalar subquery returning a struct: it is
    evaluated once, substituted as a value (no join, no broadcast table),
    and Spark fails the query if the subquery ever yields more than one
    row — the size bound is enforced, not assumed.
    """
    cols = one_row.columns
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row")).scalar()
    out = df.withColumn("__row", packed)
    return out.withColumns({c: F.col("__row")[c] for c in cols}).drop("__row")
