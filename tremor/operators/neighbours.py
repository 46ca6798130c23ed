"""Exact k nearest neighbours over a count pyramid, without all pairs.

Donors are dealt into a tree of cells: a node holds the count and the bounding
box of its donors; one with more than ``cell_rows`` of them is heavy and is
split into 4 parts along each axis of its own box.  As the box is that of the
donors, not of the space, a dense cluster far from everything is split at its
own scale.  A level is one aggregate over the donors of heavy nodes only.

Receivers go down the tree twice, all together.  First straight to the lowest
near node that holds k donors, as the counts tell; the k-th distance among its
donors bounds the true one.  Then to every cell that begins within this bound;
heavy ones are replaced by their parts, the others are closed.  So a receiver
goes on only where its neighbours can be, wherever it lies.  The donors of the
light cells that stay open are compared exactly: pairs are bounded by
receivers x open cells x ``cell_rows``, and no level pairs all with all.

Box distances are sums of the same terms in the same order as pair distances,
so rounding never closes a box that holds a neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.session import cut_lineage

CELL_ROWS = 64                  # donors of a light cell
SPLIT = 4                       # parts along an axis
TASK_RECEIVERS = 20_000         # receivers a task
SMALL_ROWS = 100_000            # nodes of a level that may be broadcast


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most that many rows (counted)."""
    return F.broadcast(df) if df.count() <= rows else df


def topk_per_point(donors: DataFrame, keys: list[str], k: int, id_col: str, salts: int = 256) -> DataFrame:
    """The k smallest ids of each point: donors that share a point differ in
    nothing else.  A hot point is split by a salt first."""
    salted = donors.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(id_col)
    stage1 = salted.withColumn("__rn", F.row_number().over(w1)).where(F.col("__rn") <= k)
    w2 = Window.partitionBy(*keys).orderBy(id_col)
    return (stage1.withColumn("__rn", F.row_number().over(w2)).where(F.col("__rn") <= k)
            .drop("__rn", "__salt"))


def _boxes(rows: DataFrame, feats: list[str], cell_rows: int) -> DataFrame:
    """One row a node: count, bounds, whether it is heavy.  Donors of one point
    cannot be told apart by a box, so such a node is light."""
    nodes = rows.groupBy("__t", "__path").agg(
        F.count(F.lit(1)).alias("__n"), *[F.min(f).alias(f"__lo_{f}") for f in feats], *[F.max(f).alias(f"__hi_{f}") for f in feats])
    wide = F.lit(False)
    for f in feats:
        wide = wide | (F.col(f"__lo_{f}") < F.col(f"__hi_{f}"))
    return nodes.withColumn("__heavy", (F.col("__n") > cell_rows) & wide)


def build_tree(donors: DataFrame, feats: list[str], cell_rows: int = CELL_ROWS) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes by level, donor rows by level).  donors: __t, the features as
    doubles, and what else belongs to them; rows gain ``__path``, the node."""
    rows = donors.withColumn("__path", F.lit(""))
    nodes = [cut_lineage(_boxes(rows, feats, cell_rows))]
    dealt = [rows]
    while not (heavy := nodes[-1].where("__heavy")).isEmpty():
        part = F.lit(0)
        for f in feats:
            lo, width = F.col(f"__lo_{f}"), F.col(f"__hi_{f}") - F.col(f"__lo_{f}")
            place = F.floor(F.try_divide(F.col(f) - lo, width) * SPLIT)
            part = part * SPLIT + F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(SPLIT - 1)).cast("int")
        inner = heavy.select("__t", "__path", *[f"__{e}_{f}" for f in feats for e in ("lo", "hi")])
        rows = (dealt[-1].join(small_side(inner), ["__t", "__path"])
                .withColumn("__path", F.concat("__path", F.lpad(F.hex(part), 2, "0"))).select(*donors.columns, "__path"))
        rows = cut_lineage(rows)
        dealt.append(rows)
        nodes.append(cut_lineage(_boxes(rows, feats, cell_rows)))
    return nodes, dealt


def _near(feats: list[str]) -> Column:
    """Squared distance of a receiver to a box."""
    gaps = [F.greatest(F.col(f"__lo_{f}") - F.col(f), F.col(f) - F.col(f"__hi_{f}"), F.lit(0.0)) for f in feats]
    return sum((g * g for g in gaps), F.lit(0.0))


def _step(now: DataFrame | None, receivers: DataFrame, level: DataFrame, depth: int, feats: list[str]) -> DataFrame:
    """A level further down: heavy nodes replaced by their parts, with the
    squared distance ``__near``; light ones stay."""
    parts = level.select("__t", *[F.col(c).alias(f"__p{c}") for c in ("__path", "__n", "__heavy")],
                         *[f"__{e}_{f}" for f in feats for e in ("lo", "hi")],
                         F.left("__path", F.lit(max(0, 2 * depth - 2))).alias("__path"))
    near = _near(feats)
    if now is None:
        met = receivers.join(small_side(parts.drop("__path")), "__t")
        return met.select(*receivers.columns, F.col("__p__path").alias("__path"), F.col("__p__n").alias("__n"),
                          F.col("__p__heavy").alias("__heavy"), near.alias("__near"))
    met = now.join(small_side(parts), ["__t", "__path"], "left")        # parts exist of heavy nodes only
    return met.select(*receivers.columns, *[F.coalesce(f"__p{c}", c).alias(c) for c in ("__path", "__n", "__heavy")],
                      F.when(F.col("__p__path").isNotNull(), near).otherwise(F.col("__near")).alias("__near"))


def _parts(level: DataFrame, depth: int, feats: list[str]) -> DataFrame:
    """A row for each node above the level, with its parts as one array."""
    boxes = [f"__{e}_{f}" for f in feats for e in ("lo", "hi")]
    return level.groupBy("__t", F.left("__path", F.lit(max(0, 2 * depth - 2))).alias("__path")).agg(
        F.collect_list(F.struct("__path", "__n", *boxes)).alias("__parts"))


def start_cells(receivers: DataFrame, nodes: list[DataFrame], feats: list[str], k: int) -> DataFrame:
    """(__t, features, __path): one node a receiver, down the nearest parts
    with k donors each, until no part has so many.  It holds k donors at least
    and few more: it is light, or its parts hold less than k each.  A target
    of less than k donors in all has no such node."""
    key = ["__t", *feats]

    def near(part: Column) -> Column:
        gaps = [F.greatest(part[f"__lo_{f}"] - F.col(f), F.col(f) - part[f"__hi_{f}"], F.lit(0.0)) for f in feats]
        return sum((g * g for g in gaps), F.lit(0.0))

    now = receivers.join(small_side(nodes[0].where(F.col("__n") >= k).select("__t", "__path")), "__t")
    for depth, level in enumerate(nodes[1:], 1):
        best = F.array_min(F.transform(F.filter("__parts", lambda p: p["__n"] >= k), lambda p: F.struct(near(p).alias("d"), p["__path"].alias("path"))))
        now = (now.join(small_side(_parts(level, depth, feats)), ["__t", "__path"], "left")
               .select(*key, F.coalesce(best["path"], "__path").alias("__path")))
    return now


def open_cells(receivers: DataFrame, nodes: list[DataFrame], feats: list[str]) -> DataFrame:
    """(__t, features, __r2, __path): the light cells that begin within each
    receiver's squared radius ``__r2`` (NULL: anywhere)."""
    key = ["__t", *feats]
    now = None
    for depth, level in enumerate(nodes):
        now = _step(now, receivers, level, depth, feats).where(F.col("__r2").isNull() | (F.col("__near") <= F.col("__r2")))
    return now.select(*key, "__r2", "__path")


def neighbour_pairs(receivers: DataFrame, donors: DataFrame, feats: list[str], k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Receiver points with the donors of their open cells that lie within the
    bound: __t, features, the donors' other columns and ``__d2``.  Both sides: __t and the features as
    doubles, none missing; receivers distinct."""
    key = ["__t", *feats]
    # a receiver is few bytes but much work: dealt by count, which keeps small shuffles from being merged into one task
    tasks = max(receivers.sparkSession.sparkContext.defaultParallelism, -(-receivers.count() // TASK_RECEIVERS))
    receivers = receivers.repartition(tasks, *key)
    nodes, dealt = build_tree(donors, feats, cell_rows)
    rows = dealt[0]
    for more in dealt[1:]:
        rows = rows.unionByName(more)           # rows of heavy nodes meet no light cell
    other = [c for c in donors.columns if c not in key]
    rows = rows.select("__t", "__path", *[F.col(f).alias(f"__d_{f}") for f in feats], *other)
    d2 = sum(((F.col(f) - F.col(f"__d_{f}")) * (F.col(f) - F.col(f"__d_{f}")) for f in feats), F.lit(0.0))

    def met(cells: DataFrame) -> DataFrame:
        kept = [c for c in cells.columns if c not in ("__path", *key)]
        return cells.join(rows, ["__t", "__path"]).select(*key, *kept, *other, d2.alias("__d2"))

    first = met(start_cells(receivers, nodes, feats, k)).groupBy(*key).agg(F.sort_array(F.collect_list("__d2")).alias("__first"))
    bound = first.select(*key, F.get("__first", F.lit(k - 1)).alias("__r2"))
    # of targets with less than k donors in all every donor is a neighbour
    few = nodes[0].where(F.col("__n") < k).select("__t")
    known = cut_lineage(bound.unionByName(receivers.join(small_side(few), "__t", "left_semi").withColumn("__r2", F.lit(None).cast("double"))))
    cells = open_cells(known.repartition(tasks, *key), nodes, feats)
    return met(cells).where(F.col("__r2").isNull() | (F.col("__d2") <= F.col("__r2"))).drop("__r2")
