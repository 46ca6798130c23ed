import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tremor.llm import ann, url_rules


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def _want(ids, x, k, is_query):
    out = {}
    for i, q in zip(ids, x):
        if is_query(i):
            score = x @ q
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("rows_per_block", [64, 10_000])
def test_recall_against_brute_force(spark, rows_per_block):
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((12, 32)) * 2
    x = (centres[rnd.integers(0, 12, 900)] + rnd.standard_normal((900, 32)) * rnd.uniform(0.2, 1.5, (900, 1))).astype(np.float32).astype(float)
    df = _vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, block_rows=rows_per_block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = _want(np.arange(900), x, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        for _, i, s in found:
            assert s == pytest.approx(float(x[q] @ x[i]), rel=1e-12)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_stopping_test_saves_work():
    rnd = np.random.default_rng(0)
    x = np.repeat(rnd.standard_normal((40, 16)) * 10, 50, 0) + rnd.standard_normal((2000, 16)) * 0.1
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    norm2 = float((x * x).sum(1).max())
    matrix = rnd.standard_normal((17, 8))
    lift = np.sqrt(np.maximum(0, norm2 - (x * x).sum(1)))

    verified = []
    found = list(ann.search_block(np.arange(2000), x, lift, np.arange(0, 2000, 50), x[::50], norm2, matrix, 10, 0.9, verified))
    assert max(verified) < 2000 and np.mean(verified) < 1000
    assert {i // 50 for q, i, _ in found if q == 0} == {0}


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05), rel=1e-9)
    assert ann.chi_square_quantile(0.99, 8) == pytest.approx(20.0902, abs=1e-3)


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (20, [0.0, 0.0], 0), (40, None, 0), (60, [nan, 1.0], 0), (80, [inf, 1.0], 0), (100, [None, 1.0], 0),
            (None, [1.0, 1.0], 0), (5, [0.5, 0.5], 0), (3, [0.5, -0.5], 0), (9, [0.5, 0.5], 0), (9, [0.5, 0.5], 1), (7, [1.0, 2.0, 3.0], 0)]
    df = _vectors(spark, rows).withColumn("rank", F.lit(1)).withColumn("block", F.lit(1)).withColumn("v", F.lit("x"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 0.5), (0, 2, 5, 0.5), (0, 3, 9, 0.5), (0, 4, 9, 0.5)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(df.where("vec_id in (20, 40)"), F.col("vec_id") % 20 == 0).collect() == []


def test_repeated_queries_and_the_commonest_length(spark):
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((300, 8)).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    want = _want(np.arange(300), x, 20, lambda i: i % 20 == 0)
    is_query = F.col("vec_id") % 20 == 0
    # every query row three times, and a row of odd length before all others
    more = [r for r in rows if r[0] % 20 == 0] * 2 + [(-1, [1.0, 2.0], 0)]
    got = {}
    for r in ann.nearest(_vectors(spark, rows + more), is_query, 60, block_rows=100, confidence=0.999999).collect():
        assert r.query_row == 0
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert sorted(r for r, _ in found) == list(range(1, 61))
        assert {i for i, _ in want[q]} <= {i for _, i in found}
    # two vectors of one id are two queries
    two = ann.nearest(_vectors(spark, [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [3.0, 1.0], 0), (2, [1.0, 3.0], 0)]), is_query, 1).collect()
    assert sorted((r.query_id, r.query_row, r.rank, r.vec_id) for r in two) == [(0, 0, 1, 2), (0, 1, 1, 1)]


def test_queries_are_cut_into_parts_too(spark):
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((400, 8)).astype(np.float32).astype(float)
    df = _vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    rows = df.select("vec_id", F.col("embedding").alias("v"))
    sides = ann.deal(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 4, 4)
    for side in sides:
        sizes = [r["count"] for r in side.groupBy("block", "part").count().collect()]
        assert len(sizes) == 16 and sum(sizes) == 1600 and max(sizes) < 160
    # every vector is a query: more queries than a block holds
    got = {}
    for r in ann.nearest(df, F.lit(True), 5, block_rows=100, confidence=0.999999).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = _want(np.arange(400), x, 5, lambda i: True)
    assert {q: [i for _, i in sorted(f)] for q, f in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def _fit(host, rule):
    return rule == "" or host == rule or host.endswith("." + rule)


def _brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, tail = rest.partition("/")
        path = slash + tail
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in rules if _fit(host, r[1]) and path.startswith(r[2])),
               key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), [-ord(c) for c in r[1] + r[2]]), default=None)
    return host, path, best[1] + best[2] if best else None, best[0] if best else "allow"


RULES = url_rules.TASK_RULES + [("block", "a.b.c", ""), ("allow", "b.c", "/x/long/path"), ("block", "c", "/x"), ("block", "", "/every")]
URLS = [None, "", "no scheme", "://", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en", "http://example.com/en/",
        "http://notexample.com/en/", "http://net/es/", "http://x.net/fr/?a", "http://x.net#frag/es/", "http://a.b.c", "http://z.a.b.c/x/long/path",
        "http://b.c/x/long/path/1", "http://q.c/x", "http://c./x", "http://.c/x", "http://a..c/x", "http://é.com/É", "http://h/every", "ftp://u:p@x.net:80/es/",
        "a://b://c/x", "http://x.com?/en/", "http://x\u0000.com/", "http://x.com/\U0010ffff"]


@pytest.mark.parametrize("rules", [url_rules.TASK_RULES, RULES])
@pytest.mark.parametrize("rows_per_range", [3, 1000])
def test_rules_equal_brute_force(spark, monkeypatch, rules, rows_per_range):
    monkeypatch.setattr(url_rules, "ROWS_PER_RANGE", rows_per_range)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(500, URLS[6])] * 40 + [(None, URLS[8])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("x"))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.rules_table(spark, rules)).collect()), key=str)
    assert got == sorted(((i, *_brute(u, rules)) for i, u in rows), key=str)


def test_rules_on_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.com/en/")], "page_id bigint, url string")
    rules = url_rules.rules_table(spark, url_rules.TASK_RULES)
    assert url_rules.judge_urls(pages.limit(0), rules).collect() == []
    only = url_rules.judge_urls(pages, rules.limit(0)).collect()
    assert [(r.rule, r.verdict) for r in only] == [(None, "allow")]


def test_rules_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    want = sorted(con.execute(url_rules.TASK_SQL).fetchall(), key=str)
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = url_rules.judge_urls(pages, url_rules.rules_table(spark, url_rules.TASK_RULES))
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want
