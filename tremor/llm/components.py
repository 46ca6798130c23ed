"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import reliable


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every node of an edge; component is the smallest
    id reachable.  Null ends and loops are ignored, repeated edges count once.

    Each round hangs every larger neighbour on the smallest one (large star),
    then every node's smaller neighbours on the smallest (small star), until
    nothing changes: stars remain.  Nothing reaches the driver but two
    numbers a round; rounds are cut by reliable checkpoints.
    """
    now = reliable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            .where("u <> v").distinct())
        now = reliable(small)
        after = _state(now)
        if after == state:
            break
        state = after
    return (now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
