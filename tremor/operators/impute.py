"""Imputation: batch median (P35) and exact k-nearest-neighbour mean.

A NULL target gets the mean target of its ``k`` nearest rows (Euclidean on
raw feature values, ties by donor id) among rows that have a value.  Donors
that share a point are reduced to their ``k`` smallest ids, receivers to
distinct points; the search between them is ``operators/neighbours.py``.
Rows lacking a feature (NULL, NaN, or so large that its square is infinite)
neither give nor get a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.common import attach_row
from tremor.operators.neighbours import CELL_ROWS, neighbour_pairs, topk_per_point
from tremor.operators.quantiles import exact_quantile
from tremor.session import cut_lineage


LARGEST = 1e150


def impute_median(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    """NULL -> the column's median over the batch, attached to every row
    as a scalar subquery.

    ``exact``: True (exact with bounded memory,
    :func:`tremor.operators.quantiles.exact_quantile`, only for columns that
    have something to fill) or False (a quantile sketch).
    """
    cols = list(cols)
    if exact:
        # one aggregate (one row) tells which columns have anything to fill
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
        cols = [c for c in cols if nulls[c]]
        if not cols:
            return df
        stats = None
        for c in cols:
            q = exact_quantile(df, c, 0.5, [], out=f"__med_{c}")
            stats = q if stats is None else attach_row(stats, q)
    else:
        stats = df.agg(*[F.percentile_approx(c, 0.5, 10000).alias(f"__med_{c}") for c in cols])
    out = attach_row(df, stats)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__med_{c}")) for c in cols}).drop(
        *[f"__med_{c}" for c in cols])


def knn_means(df: DataFrame, targets, feats=("latitude", "longitude", "hour"), k: int = 5, id_col: str = "id",
              cell_rows: int = CELL_ROWS) -> DataFrame:
    """For every target column (index ``__t``) and every distinct receiver
    point, the mean target of its k nearest donors (``__knn``); receivers
    with no donor at all get no row (their value stays NULL).

    All targets run together: rows are exploded into (target, value) pairs
    once, and every join, window and aggregate is keyed by the target, so
    a level of the tree is one job for all targets.
    """
    targets = [targets] if isinstance(targets, str) else list(targets)
    feats = list(feats)
    ok = F.lit(True)
    for f in feats:
        ok = ok & F.coalesce(F.abs(F.col(f).cast("double")) < LARGEST, F.lit(False))
    pairs_tv = F.explode(F.array(*[F.struct(F.lit(i).alias("__t"), F.col(t).cast("double").alias("__v"))
                                   for i, t in enumerate(targets)])).alias("__e")
    src = df.where(ok).select(F.col(id_col).alias("__did"), *[F.col(f).cast("double").alias(f) for f in feats], pairs_tv)
    src = src.select("__did", *feats, "__e.__t", "__e.__v")
    pkey = ["__t", *feats]
    # both are read by every level of the tree
    donors = cut_lineage(topk_per_point(src.where(F.col("__v").isNotNull()), pkey, k, "__did").select(*pkey, "__did", "__v"))
    receivers = cut_lineage(src.where(F.col("__v").isNull()).select(*pkey).distinct())
    w = Window.partitionBy(*pkey).orderBy("__d2", "__did")
    return (neighbour_pairs(receivers, donors, feats, k, cell_rows)
            .withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).groupBy(*pkey).agg(F.avg("__v").alias("__knn")))


def impute_knn_many(df: DataFrame, targets, feats=("latitude", "longitude", "hour"), k: int = 5,
                    id_col: str = "id") -> DataFrame:
    """P36 for several target columns at once: each NULL gets the mean of its
    k nearest donors for that column.  The per-target means are pivoted to
    one row per point (explicit pivot values, no extra job) and joined back
    once."""
    targets = list(targets)
    feats = list(feats)
    means = knn_means(df, targets, feats, k, id_col)
    wide = means.groupBy(*feats).pivot("__t", list(range(len(targets)))).agg(F.first("__knn"))
    wide = wide.select(*feats, *[F.col(f"`{i}`").alias(f"__knn_{i}") for i in range(len(targets))])
    # only rows with something to fill meet the means; the rest pass by, so a
    # hot location's complete rows are not shuffled onto one key
    lacking = F.col(targets[0]).isNull()
    for t in targets[1:]:
        lacking = lacking | F.col(t).isNull()
    out = df.where(lacking).join(wide, feats, "left")
    out = out.withColumns({t: F.coalesce(F.col(t), F.col(f"__knn_{i}")) for i, t in enumerate(targets)}).select(*df.columns)
    return out.unionByName(df.where(~lacking))


def impute_knn(df: DataFrame, target: str, feats=("latitude", "longitude", "hour"), k: int = 5,
               id_col: str = "id") -> DataFrame:
    """Fill NULL ``target`` with the mean of its k nearest donors."""
    return impute_knn_many(df, [target], feats, k, id_col)
