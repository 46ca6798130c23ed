"""Nearest vectors by stable projections under a kd-tree (with a chi-square stop).

Largest inner product becomes nearest distance by one more coordinate that
lifts all vectors to the largest norm (queries get zero there).  A Gaussian
matrix projects to a few dimensions; as normal variables are 2-stable, the
squared projected distance over the squared true one is chi-square
distributed.  Rows are dealt into blocks; each builds a kd-tree over its
projections.  A query takes leaves in order of their projected distance
(the incremental neighbours come a leaf at a time), verifies their vectors by
exact inner products in double precision and stops when the next leaf's
distance r satisfies

    P(chi2_m <= r^2 / d_k^2) >= confidence,

d_k being the distance of its k-th best so far: a vector as near as that would
by then have been met with this probability.  Queries are dealt into parts of
bounded size too; a task searches one block for one part.  Block results are
merged by a ranked window per query.

Every row is indexed; queries are a stated set, sent to all blocks.  Vectors
that are null, zero, of another length than the commonest (of equally common
ones the smallest) or with null or non-finite components take no part, nor do
rows without vec_id.  A query with fewer candidates than k gets all.  Ties go
to the smaller vec_id; repeated rows are candidates of their own, but one
query.  Different vectors of one id are a query each, told apart by
``query_row``, which counts them from 0 in order of the vectors; candidates
of a query's own id are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import bounded_broadcast, reliable

PROJECTED = 8                   # dimensions under the tree
BLOCK_ROWS = 16_384             # expected rows of a block
LEAF_ROWS = 64
LEAVES_AT_ONCE = 8
CONFIDENCE = 0.99


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi2_m <= x) = p, for even m (a finite Poisson sum), by bisection."""
    def below(x: float) -> float:
        term, total = math.exp(-x / 2), 0.0
        for i in range(m // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class ProjectedTree:
    """kd-tree over projections: leaves as runs of rows with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(points))
        runs, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                runs.append((a, b))
                continue
            part = points[order[a:b]]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        runs.sort()
        self.order = order
        self.runs = runs
        self.low = np.array([points[order[a:b]].min(axis=0) for a, b in runs])
        self.high = np.array([points[order[a:b]].max(axis=0) for a, b in runs])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of a projected query to the leaves' boxes."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        return (gap * gap).sum(axis=1)


def search_block(ids: np.ndarray, vectors: np.ndarray, lift: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 norm2: float, matrix: np.ndarray, k: int, confidence: float, verified: list[int] | None = None):
    """(query id, vec_id, score) of each query's best k of the block; how many
    vectors each query verified is added to ``verified``."""
    for number, found, score in search_places(ids, vectors, lift, query_ids, queries, norm2, matrix, k, confidence, verified):
        yield int(query_ids[number]), found, score


def search_places(ids: np.ndarray, vectors: np.ndarray, lift: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                  norm2: float, matrix: np.ndarray, k: int, confidence: float, verified: list[int] | None = None):
    """As ``search_block``, with the query's place instead of its id."""
    tree = ProjectedTree(vectors @ matrix[:-1] + lift[:, None] * matrix[-1])
    ids, vectors = ids[tree.order], vectors[tree.order]
    limit = chi_square_quantile(confidence, matrix.shape[1])
    projected = queries @ matrix[:-1]
    begins = np.array([a for a, _ in tree.runs] + [len(ids)])
    for number, q in zip(range(len(queries)), queries):
        gap = tree.distances(projected[number])
        near = np.argsort(gap, kind="stable")
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        qq = float(q @ q)
        seen = 0
        for at in range(0, len(near), LEAVES_AT_ONCE):
            if len(best) == k:
                # squared distance of lifted vectors: |x|^2 + |q|^2 - 2 <x, q> with |x|^2 = norm2
                d2 = max(0.0, norm2 + qq - 2 * best[-1])
                if gap[near[at]] >= limit * d2 and d2 > 0:
                    break
            leaves = near[at:at + LEAVES_AT_ONCE]
            rows = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in leaves])
            seen += len(rows)
            score = vectors[rows] @ q
            found = ids[rows]
            other = found != query_ids[number]
            if len(best) == k:
                other &= score >= best[-1]
            best_id, best = np.concatenate([best_id, found[other]]), np.concatenate([best, score[other]])
            if len(best) > k or at == 0:
                order = np.lexsort((best_id, -best))[:k]
                best_id, best = best_id[order], best[order]
        if verified is not None:
            verified.append(seen)
        order = np.lexsort((best_id, -best))[:k]
        for i in order:
            yield number, int(best_id[i]), float(best[i])


def _valid(embeddings: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.coalesce(F.col("v").isNotNull() & good, F.lit(False))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width) if isinstance(column, pa.ChunkedArray) \
        else column.flatten().to_numpy().reshape(-1, width)


def deal(indexed: DataFrame, queries: DataFrame, blocks: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``block`` and ``part``: each row of a side meets every
    row of the other once."""
    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    return (indexed.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("part", each(parts)),
            queries.withColumn("part", F.pmod(F.xxhash64("query_id", "q"), F.lit(parts)).cast("int")).withColumn("block", each(blocks)))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, projected: int = PROJECTED,
            confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score, query_row.  ``is_query`` is a condition on vec_id."""
    rows = reliable(_valid(embeddings))
    first = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if first is None:
        return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, query_row int")
    width = first.width
    rows = rows.where(F.size("v") == width)
    norm2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    blocks = max(1, -(-first.n // block_rows))
    matrix = np.random.default_rng(seed).standard_normal((width + 1, projected))
    top = float(norm2)

    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    queries = reliable(queries.withColumn("query_row", F.row_number().over(Window.partitionBy("query_id").orderBy("q")) - 1))
    indexed, queries = deal(rows, queries, blocks, max(1, -(-queries.count() // block_rows)))

    def solve(key, left, right):
        columns = [()] * 4
        if left.num_rows and right.num_rows:
            x = _matrix(left.column("v"), width)
            lift = np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))
            found = search_places(left.column("vec_id").to_numpy(), x, lift, right.column("query_id").to_numpy(),
                                  _matrix(right.column("q"), width), top, matrix, k, confidence)
            query_id, query_row = right.column("query_id").to_pylist(), right.column("query_row").to_pylist()
            columns = list(zip(*((query_id[i], query_row[i], c, s) for i, c, s in found))) or columns
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))],
                        names=["query_id", "query_row", "vec_id", "score"])

    near = (indexed.groupBy("block", "part").cogroup(queries.groupBy("block", "part"))
            .applyInArrow(solve, "query_id bigint, query_row int, vec_id bigint, score double"))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "query_row"))
