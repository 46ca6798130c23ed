"""Encoding and feature alignment."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_hot(df: DataFrame, col: str, vocab: list[str], prefix: str | None = None) -> DataFrame:
    """Fixed-vocabulary one-hot; unseen or NULL values give all zeros."""
    p = prefix if prefix is not None else f"{col}_"
    return df.withColumns({f"{p}{v}": F.when(F.col(col) == F.lit(v), 1).otherwise(0) for v in vocab})


def align(df: DataFrame, names: list[str], keep=()) -> DataFrame:
    """Select the model's features in order; absent ones become 0."""
    present = set(df.columns)
    return df.select(*keep, *[(F.col(n).cast("double") if n in present else F.lit(0.0)).alias(n) for n in names])


def assemble(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """Feature vector on the same row as the identity columns (no
    positional re-join), via MLlib's VectorAssembler."""
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(df)
