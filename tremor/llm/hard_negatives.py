"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

Components x become the integers floor(256 * x) (x as double); scores are
exact integer inner products.  One more coordinate lifts every vector to the
largest norm, T = the largest squared norm, and is zero for anchors; then the
squared distance of a vector to an anchor a is T + |a|^2 - 2 * score, so a
window of scores is an annulus of distances around the anchor.

A node of the tree holds a few split points; every row belongs to the nearest
of them (so cells are bounded by hyperplanes), and for each pair (split point
i, subtree j) the node stores the least and the largest distance from i to the
rows of j.  A query at distance d from split point i whose window is the
annulus [near, far] needs subtree j only if this range meets
[max(d - far, near - d), d + far]; one i without a meeting eliminates j.  When
a window has its k rows, the k-th score narrows the annulus.  Leaves are
scored exactly.

The top node is a Spark stage: its split points come from a bounded sample,
its ranges from an aggregate over all rows.  Anchors go only to the cells that
their windows leave open (the sample's own rows narrow the windows before),
cells are cut into blocks of bounded size, anchors into parts of bounded size,
and a task builds the tree of one block and searches it for one part.  Every
row is indexed and every anchor is searched; results are exact.

Rows with a null vec_id, label or vector, an empty vector, a null or non-finite
component, or of another length than the commonest (of equally common ones the
smallest) take no part, nor do vectors whose integer squared norm exceeds
2^62, since no long holds their score.  Ties go to the smaller vec_id.  Rows
alike in vec_id, label and vector count once.  Different rows of one id are
rows of their own (as anchors told apart by ``anchor_row``, counted from 0),
but never each other's positives or negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import reliable

TOP_SPLITS = 64                 # cells of the top node at most
SAMPLE_ROWS = 2_048             # expected rows of the sample (split points, first bounds)
BLOCK_ROWS = 65_536             # expected rows of a block, queries of a part
SPLITS, LEAF_ROWS = 16, 256     # inside a block
QUERIES_AT_ONCE = 1_024
LEAST = -(1 << 62)              # no product of two kept vectors is smaller
QUERY = ["query_id", "query_row", "label", "v", "low", "high"]
_NONE = np.iinfo(np.int64).min
_LARGEST_NORM2 = float(1 << 62)


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vectors.astype(np.float64))


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of all rows of a with all of b (whole numbers held
    as doubles), as int64; ``most`` bounds them and all their partial sums."""
    if most < float(1 << 53):
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def choose_splits(points: np.ndarray, count: int) -> np.ndarray:
    """Indices of up to ``count`` points far from each other, the first point
    first; fewer if no more are distinct."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (others * others).sum(axis=1)[None, :] - 2 * points @ others.T
    return np.sqrt(np.maximum(0, square))


def open_cells(to_splits: np.ndarray, near: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """(queries, cells): whether the ranges of all split points meet the annuli.
    to_splits: (queries, splits); low, high: (splits, cells)."""
    reach = (to_splits + far[:, None] + slack)[:, :, None]
    rest = (np.maximum(to_splits - far[:, None], near[:, None] - to_splits) - slack)[:, :, None]
    return ((low[None] <= reach) & (high[None] >= rest)).all(axis=1)


def slack_of(top: float, square: float) -> float:
    """More than rounding moves any distance: no subtree is lost by it."""
    return 1e-6 * float(np.sqrt(top + square)) + 1e-9


class RangeTree:
    """Tree over lifted vectors; a node is an array of rows (a leaf) or
    (split points, children, low, high)."""

    def __init__(self, points: np.ndarray, seed: int = 11):
        self.points = points
        self.random = np.random.default_rng(seed)
        self.root = self._node(np.arange(len(points)))

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF_ROWS:
            return rows
        drawn = self.points[self.random.choice(rows, 3 * SPLITS, replace=False)]
        splits = drawn[choose_splits(drawn, SPLITS)]
        gap = distances(self.points[rows], splits)
        cell = np.argmin(gap, axis=1)
        parts = [np.flatnonzero(cell == j) for j in range(len(splits))]
        if max(len(p) for p in parts) == len(rows):
            return rows
        kept = [p for p in parts if len(p)]
        return (splits, [self._node(rows[p]) for p in kept],
                np.stack([gap[p].min(axis=0) for p in kept], 1), np.stack([gap[p].max(axis=0) for p in kept], 1))


class Windows:
    """The state of a batch of windows: query q's first k rows by score
    (descending, then id) with low <= score <= high."""

    def __init__(self, vectors, square, ids, labels, low, high, same: bool, k: int, top: float):
        self.vectors, self.square, self.ids, self.labels = vectors, square, ids, labels
        self.low, self.high, self.same, self.k, self.top = low.copy(), high, same, k, top
        self.best = np.full((k, len(ids)), _NONE)
        self.best_id = np.full((k, len(ids)), np.iinfo(np.int64).max)
        self.lifted = np.concatenate([vectors, np.zeros((len(ids), 1))], axis=1)

    def annulus(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = self.top + self.square[which]
        return (np.sqrt(np.maximum(0.0, whole - 2.0 * self.high[which])), np.sqrt(np.maximum(0.0, whole - 2.0 * self.low[which])))

    def take(self, which: np.ndarray, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> None:
        """Offer rows in order of id (score: rows by queries) to these queries."""
        fits = ((labels[:, None] == self.labels[which][None, :]) == self.same) & (ids[:, None] != self.ids[which][None, :])
        fits &= (score >= self.low[which][None, :]) & (score <= self.high[which][None, :])
        hit = np.flatnonzero(fits.any(axis=0))
        if not len(hit):
            return
        which, score = which[hit], np.where(fits[:, hit], score[:, hit], _NONE)
        every = np.arange(len(hit))
        found, found_id = [self.best[:, which]], [self.best_id[:, which]]
        for _ in range(min(self.k, len(ids))):
            first = np.argmax(score, axis=0)                # of equal scores the smallest id
            value = score[first, every]
            found.append(value[None])
            found_id.append(np.where(value > _NONE, ids[first], np.iinfo(np.int64).max)[None])
            score[first, every] = _NONE
        found, found_id = np.concatenate(found), np.concatenate(found_id)
        order = np.lexsort((found_id, ~found), axis=0)[:self.k]     # ~ reverses without overflow
        self.best[:, which] = np.take_along_axis(found, order, 0)
        self.best_id[:, which] = np.take_along_axis(found_id, order, 0)
        self.low[which] = np.maximum(self.low[which], self.best[-1, which])


def search_block(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: float, windows: Windows, scored: list[int] | None = None) -> None:
    """Search a block for all windows; the pairs scored are counted in ``scored``."""
    order = np.argsort(ids, kind="stable")
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    square = (vectors * vectors).sum(axis=1)
    tree = RangeTree(np.concatenate([vectors, np.sqrt(np.maximum(0.0, top - square))[:, None]], axis=1))
    most = float(np.sqrt(square.max(initial=0)) * np.sqrt(windows.square.max(initial=0))) * 1.01
    slack = slack_of(top, windows.square.max(initial=0))

    def visit(node, which: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            for at in range(0, len(node), LEAF_ROWS):
                rows = np.sort(node[at:at + LEAF_ROWS])
                windows.take(which, ids[rows], labels[rows], products(vectors[rows], windows.vectors[which], most))
                if scored is not None:
                    scored.append(len(rows) * len(which))
            return
        splits, children, low, high = node
        gap = distances(windows.lifted[which], splits)
        for j in np.argsort((gap.mean(axis=0)[:, None] - high).max(axis=0), kind="stable"):       # likely near ones first
            near, far = windows.annulus(which)
            alive = (far >= near - slack) & open_cells(gap, near, far, low[:, [j]], high[:, [j]], slack)[:, 0]
            if alive.any():
                visit(children[j], which[alive])

    for at in range(0, len(windows.ids), QUERIES_AT_ONCE):
        visit(tree.root, np.arange(at, min(at + QUERIES_AT_ONCE, len(windows.ids))))


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class TopNode:
    """The top of the tree as tasks need it: sample, split points, ranges and
    blocks a cell, all of bounded size."""

    def __init__(self, sample: pa.Table, width: int, count: int, top: float, block_rows: int, top_splits: int):
        self.width, self.top = width, top
        order = np.lexsort((sample.column("label").to_numpy(), sample.column("vec_id").to_numpy()))
        self.ids, self.labels = sample.column("vec_id").to_numpy()[order], sample.column("label").to_numpy()[order]
        self.vectors = integers(_matrix(sample.column("v"), width))[order]
        lifted = self.lift(self.vectors)
        self.splits = lifted[choose_splits(lifted, max(1, min(top_splits, 4 * -(-count // block_rows))))]

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors, np.sqrt(np.maximum(0.0, self.top - (vectors * vectors).sum(axis=1)))[:, None]], axis=1)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = distances(self.lift(vectors), self.splits)
        return np.argmin(gap, axis=1), gap

    def measured(self, ranges: pa.Table, block_rows: int) -> None:
        m = len(self.splits)
        i, j = ranges.column("i").to_numpy(), ranges.column("j").to_numpy()
        self.low, self.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        self.low[i, j], self.high[i, j] = ranges.column("low").to_numpy(), ranges.column("high").to_numpy()
        size = np.zeros(m, np.int64)
        size[j] = ranges.column("n").to_numpy()
        self.blocks = [int(b) for b in np.maximum(1, -(-size // block_rows))]

    def windows(self, table, same: bool, k: int) -> tuple[Windows, np.ndarray]:
        """Windows of query rows (query_id, query_row, label, v, low, high), and
        the row each belongs to."""
        lows, highs = table.column(4).to_pylist(), table.column(5).to_pylist()
        owner = np.repeat(np.arange(table.num_rows), [len(x) for x in lows])
        vectors = integers(_matrix(table.column(3), self.width))[owner]
        return Windows(vectors, (vectors * vectors).sum(axis=1), table.column(0).to_numpy()[owner], table.column(2).to_numpy()[owner],
                       np.array([x for row in lows for x in row], np.int64), np.array([x for row in highs for x in row], np.int64),
                       same, k, self.top), owner

    def route(self, table, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(row, cell) of the cells that some window of a row leaves open, and
        the rows' lower ends as the sample's rows narrow them."""
        windows, owner = self.windows(table, same, k)
        norm = windows.square.max(initial=0)
        most = float(np.sqrt((self.vectors ** 2).sum(axis=1).max() * norm)) * 1.01
        every = np.arange(len(owner))
        for s in range(0, len(self.ids), LEAF_ROWS):
            part = slice(s, s + LEAF_ROWS)
            windows.take(every, self.ids[part], self.labels[part], products(self.vectors[part], windows.vectors, most))
        slack = slack_of(self.top, norm)
        near, far = windows.annulus(every)
        open_to = open_cells(distances(windows.lifted, self.splits), near, far, self.low, self.high, slack) & (far >= near - slack)[:, None]
        goes = np.zeros((table.num_rows, len(self.splits)), bool)
        np.logical_or.at(goes, owner, open_to)
        ends = np.searchsorted(owner, np.arange(table.num_rows + 1)).astype(np.int32)
        return *np.nonzero(goes), pa.ListArray.from_arrays(pa.array(ends), pa.array(windows.low))


def top_node(rows: DataFrame, width: int, count: int, top: float, block_rows: int = BLOCK_ROWS, top_splits: int = TOP_SPLITS,
             sample_rows: int = SAMPLE_ROWS) -> TopNode:
    """The top node over all rows (vec_id, label, v): the sample by a hash of
    the row, ranges and counts from one small table a task, then an aggregate."""
    draw = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(1 << 30)) < int(min(1.0, sample_rows / count) * (1 << 30))
    sample = rows.where(draw).toArrow()
    node = TopNode(sample if sample.num_rows else rows.limit(1).toArrow(), width, count, top, block_rows, top_splits)
    m = len(node.splits)

    def run(batches):
        n = np.zeros(m, np.int64)
        low, high = np.full((m, m), np.inf), np.full((m, m), -np.inf)      # by cell, then split point
        for batch in batches:
            if batch.num_rows:
                cell, gap = node.cells(integers(_matrix(batch.column(0), width)))
                n += np.bincount(cell, minlength=m)
                np.minimum.at(low, cell, gap)
                np.maximum.at(high, cell, gap)
        some = np.flatnonzero(n)
        i, j = np.tile(np.arange(m), len(some)), np.repeat(some, m)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, n[j], low[j, i], high[j, i])], names=["i", "j", "n", "low", "high"])

    node.measured(rows.select("v").mapInArrow(run, "i bigint, j bigint, n bigint, low double, high double")
                  .groupBy("i", "j").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow(), block_rows)
    return node


def _blocks_of(node: TopNode) -> Column:
    return F.element_at(F.array(*[F.lit(b).cast("bigint") for b in node.blocks]), (F.col("cell") + 1).cast("int"))


def dealt(rows: DataFrame, node: TopNode) -> DataFrame:
    """cell, vec_id, label, v, block of all rows."""

    def run(batches):
        for batch in batches:
            cell = node.cells(integers(_matrix(batch.column(2), node.width)))[0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *batch.columns], names=["cell", "vec_id", "label", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    out = rows.select("vec_id", "label", "v").mapInArrow(run, f"cell bigint, vec_id bigint, label bigint, v {kind}")
    return out.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), _blocks_of(node)))


def routed(queries: DataFrame, node: TopNode, same: bool, k: int) -> DataFrame:
    """A row for each query and cell that one of its windows leaves open."""
    kind = queries.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, cell, lows = node.route(part, same, k)
                columns = [c.take(pa.array(row)) for c in (*part.columns[:4], lows, part.column(5))]
                yield pa.RecordBatch.from_arrays([pa.array(cell), *columns], names=["cell", *QUERY])

    return queries.select(*QUERY).mapInArrow(
        run, f"cell bigint, query_id bigint, query_row int, label bigint, v {kind}, low array<bigint>, high array<bigint>")


def first_in_windows(rows: DataFrame, node: TopNode, queries: DataFrame, same: bool, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, query_row, window (its place in the arrays, from 0), vec_id,
    score, rank: the first k rows of each window, of the query's own label or
    of others.  queries: query_id, query_row, label, v and the windows' ends
    as arrays low and high."""
    parts = max(1, -(-queries.count() // block_rows))
    asks = (routed(queries, node, same, k).withColumn("part", F.pmod(F.xxhash64("query_id", "query_row"), F.lit(parts).cast("bigint")))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), _blocks_of(node) - 1))))
    table = dealt(rows, node).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))

    def solve(key, left, right):
        columns = [()] * 5
        if left.num_rows and right.num_rows:
            asked = right.select(QUERY)
            windows, owner = node.windows(asked, same, k)
            search_block(left.column("vec_id").to_numpy(), left.column("label").to_numpy(), integers(_matrix(left.column("v"), node.width)),
                         node.top, windows)
            place, window = np.nonzero(windows.best > _NONE)
            number = np.arange(len(owner)) - np.searchsorted(owner, owner)
            columns = [windows.ids[window], asked.column("query_row").to_numpy()[owner[window]], number[window],
                       windows.best_id[place, window], windows.best[place, window]]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "query_row", "window", "vec_id", "score"])

    found = (table.groupBy("cell", "block", "part").cogroup(asks.groupBy("cell", "block", "part"))
             .applyInArrow(solve, "query_id bigint, query_row int, window int, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id", "query_row", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _valid(embeddings: DataFrame, label: Column) -> DataFrame:
    kind = embeddings.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    number = F.transform(v, lambda x: x.cast("double"))
    norm2 = F.aggregate(number, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256.0).cast("double"), 2.0))
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)) & (F.size(v) > 0)
    return (embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), v.alias("v"),
                              F.when(finite, norm2).alias("norm2"))
            .where((F.col("norm2") <= _LARGEST_NORM2) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()))


def mine(embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
         low_percent: int = 50, high_percent: int = 95, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score, anchor_row: for each anchor and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels whose score lies between the two shares of the positive's.

    ``is_anchor`` is a condition on vec_id, ``label`` an expression over the
    table's columns (``label`` if none); ``sizes`` go to
    ``top_node``.  An empty
    table, or one without anchors, gives an empty result.
    """
    rows = _valid(embeddings, F.col("label") if label is None else label)
    common = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if common is None:
        return embeddings.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                                           "positive_score bigint, negative_score bigint, anchor_row int")
    rows = reliable(rows.where(F.size("v") == common.width).distinct())
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("top")).first()
    vectors = rows.select("vec_id", "label", "v")
    node = top_node(vectors, common.width, told.n, told.top, **sizes)
    block_rows = sizes.get("block_rows", BLOCK_ROWS)

    everything = [F.array(F.lit(x).cast("bigint")).alias(c) for x, c in ((LEAST, "low"), (-LEAST, "high"))]
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("query_id"), "label", "v")
    anchors = reliable(anchors.withColumn("query_row", F.row_number().over(Window.partitionBy("query_id").orderBy("label", "v")) - 1))
    near = reliable(first_in_windows(vectors, node, anchors.select("*", *everything), True, positives, block_rows)
                    .select("query_id", "query_row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
                    .where("positive_score >= 0"))             # the window of a negative score is empty
    near = near.withColumn("low", F.expr(f"(cast(positive_score as decimal(19,0)) * {low_percent} + 99) div 100"))
    near = near.withColumn("high", F.expr(f"(cast(positive_score as decimal(19,0)) * {high_percent}) div 100"))
    asked = (near.groupBy("query_id", "query_row").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
             .select("query_id", "query_row", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.col("w.place").alias("places")))
    asks = reliable(anchors.join(asked, ["query_id", "query_row"]))
    hard = first_in_windows(vectors, node, asks, False, negatives, block_rows)
    place = asks.select("query_id", "query_row", F.posexplode("places").alias("window", "place"))
    return (hard.join(place, ["query_id", "query_row", "window"]).join(near, ["query_id", "query_row", "place"])
            .select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score"), F.col("query_row").alias("anchor_row")))
