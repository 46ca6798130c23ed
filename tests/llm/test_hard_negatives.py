import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tremor.llm import hard_negatives as H
from tremor.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"
def relabelled():
    return F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")


def brute(rows, is_anchor, relabel=True, k=5, hard=3, low=50, high=95):
    """All rows against all, in whole numbers."""
    kept = set()
    for i, v, c in rows:
        if i is None or c is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.add((i, (c + 1) % 10 if relabel and i % 7 == 0 else c, tuple(int(np.floor(256.0 * float(np.float32(x)))) for x in v), tuple(v)))
    width = max(sorted({len(v) for *_, v in kept}), key=lambda w: (sum(len(v) == w for *_, v in kept), -w), default=0)
    kept = [r for r in kept if len(r[2]) == width]
    out = []
    for i, c, x, v in kept:
        if not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), j, d) for j, d, y, _ in kept if j != i]
        place = sorted((d, w) for j, d, _, w in kept if j == i).index((c, v))
        for ps, pid, _ in sorted(((s, j, d) for s, j, d in scored if d == c), key=lambda t: (-t[0], t[1]))[:k]:
            window = sorted(((-s, j) for s, j, d in scored if d != c and low * ps <= 100 * s <= high * ps))[:hard]
            out += [(i, pid, r + 1, j, ps, -s, place) for r, (s, j) in enumerate(window)]
    return sorted(out)


def collected(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score, r.anchor_row) for r in df.collect())


def vectors(seed, n, width, labels=10, spread=0.15):
    rnd = np.random.default_rng(seed)
    middle = rnd.standard_normal((labels, width)) * spread
    label = rnd.integers(0, labels, n)
    x = middle[label] + rnd.standard_normal((n, width)) * spread
    return [(i, [float(np.float32(c)) for c in v], int(c2)) for i, v, c2 in zip(range(n), x, label)]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 100, "sample_rows": 50}, {"block_rows": 40, "top_splits": 3, "sample_rows": 9}])
def test_equals_brute_force(spark, sizes):
    rows = vectors(3, 700, 12)
    rows += [(1000 + i, rows[5][1], 3) for i in range(60)] + [(2000 + i, rows[5][1], rows[5][2]) for i in range(20)]      # ties
    got = collected(H.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 25 == 0, relabelled(), **sizes))
    assert len(got) > 200 and got == brute(rows, lambda i: i % 25 == 0)


def test_whole_table_equals_brute_force_and_sql(spark):
    import duckdb
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    got = QUERIES["op12_range_tree_negatives"](spark, SF_SMALL)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]
    got = sorted(tuple(r) for r in got.collect())
    assert got == [r[:-1] for r in brute(rows, lambda i: i % 50 == 0)]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF_SMALL}/embeddings.parquet'")
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert sorted(con.execute(f"select {columns} from ({ORACLE['op12_range_tree_negatives']})").fetchall()) == got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(8, 120, 4, labels=3)
    odd = [(None, [1.0] * 4, 1), (500, None, 1), (505, [1.0] * 4, None), (510, [1.0, None, 1.0, 1.0], 1), (515, [nan, 1.0, 1.0, 1.0], 2),
           (520, [1.0, inf, 1.0, 1.0], 1), (525, [1.0] * 5, 1), (530, [], 1), (535, [0.0] * 4, 0), (540, [1e30] * 4, 1)]
    same_id = [(0, [0.5, 0.5, 0.5, 0.5], 1), (0, [0.5, 0.5, 0.5, 0.5], 2), (0, [0.1, 0.2, 0.3, 0.4], 1), (-5, [0.3, 0.1, 0.2, 0.1], 1), (7, [0.9] * 4, 1)]
    rows = good + good[:30] + odd + same_id
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("query_id", "v", "cell", "block", "part", "score", "window", "norm2", "low"):
        frame = frame.withColumn(name, F.lit("x"))
    want = brute([r for r in rows if r[0] != 540], lambda i: i % 5 == 0)        # no long holds the products of that vector
    assert collected(H.mine(frame, F.col("vec_id") % 5 == 0, relabelled())) == want and want
    assert H.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).collect() == []
    assert H.mine(spark.createDataFrame(good, SCHEMA), F.col("vec_id") < 0).collect() == []


def test_large_components_stay_exact(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.integers(-3_000_000, 3_000_000, 6)], int(i % 3)) for i in range(150)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = collected(H.mine(frame, F.col("vec_id") % 10 == 0))
    assert got and max(r[4] for r in got) > 1 << 53
    want = []
    whole = [(i, c, [int(256 * x) for x in v]) for i, v, c in rows]
    for i, c, x in whole:
        if i % 10 == 0:
            scored = [(sum(a * b for a, b in zip(x, y)), j, d) for j, d, y in whole if j != i]
            for ps, pid, _ in sorted(((s, j, d) for s, j, d in scored if d == c), key=lambda t: (-t[0], t[1]))[:5]:
                window = sorted((-s, j) for s, j, d in scored if d != c and 50 * ps <= 100 * s <= 95 * ps)[:3]
                want += [(i, pid, r + 1, j, ps, -s, 0) for r, (s, j) in enumerate(window)]
    assert got == sorted(want)


def test_ranges_eliminate_siblings():
    rnd = np.random.default_rng(2)
    middle = rnd.standard_normal((30, 8)) * 400
    x = np.rint(np.repeat(middle, 200, axis=0) + rnd.standard_normal((6000, 8)) * 10)
    square = (x * x).sum(axis=1)
    top, ids, labels = float(square.max()), np.arange(6000), np.repeat(np.arange(30), 200)
    ask = np.arange(0, 6000, 60)
    windows = H.Windows(x[ask], square[ask], ids[ask], labels[ask], np.full(100, H.LEAST), np.full(100, -H.LEAST), True, 5, top)
    scored = []
    H.search_block(ids, labels, x, top, windows, scored)
    for q, i in enumerate(ask):
        score = x @ x[i]
        want = sorted((-s, j) for j, s in enumerate(score) if j != i and labels[j] == labels[i])[:5]
        assert [(-int(s), int(j)) for s, j in zip(windows.best[:, q], windows.best_id[:, q])] == [(int(s), j) for s, j in want]
    assert sum(scored) < 0.7 * 6000 * 100
    # a node's ranges hold for every row of its subtrees
    tree = H.RangeTree(np.concatenate([x, np.sqrt(top - square)[:, None]], axis=1))

    def rows_of(node):
        return node if isinstance(node, np.ndarray) else np.concatenate([rows_of(c) for c in node[1]])

    def hold(node):
        if not isinstance(node, np.ndarray):
            splits, children, low, high = node
            for j, child in enumerate(children):
                gap = H.distances(tree.points[rows_of(child)], splits)
                assert (gap >= low[:, j] - 1e-6).all() and (gap <= high[:, j] + 1e-6).all()
                hold(child)

    hold(tree.root)
    assert sorted(rows_of(tree.root)) == list(range(6000))
