"""A11, A12 on columns that never change (a large catalogue has every place in every week)."""

import datetime as dt
import math

import duckdb

from tremor.operators import stats as ST
from tremor.plans import catalog


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5, None), (1.0, 3.0, 7, None), (1.0, 5.0, 1, None), (9.0, None, 1, None)],
                               "a double, b double, c int, d double")
    got = {r.feature: r["corr"] for r in ST.corr_target(df, ["a", "c", "d"], "b").collect()}
    assert math.isnan(got["a"]) and abs(got["c"] + 0.785714) < 1e-6 and got["d"] is None      # a varies only where b is missing
    cells = {(r.feature_a, r.feature_b): r["corr"] for r in ST.corr_matrix(df.where("b is not null"), ["a", "b", "c"]).collect()}
    assert cells["a", "a"] == 1.0 and math.isnan(cells["a", "b"]) and math.isnan(cells["b", "a"])
    assert abs(cells["b", "c"] + 0.785714) < 1e-6


def test_queries_with_one_place(spark, tmpdir_path):
    """One customer: nb_zones and its lags are 1 in every week."""
    day = dt.datetime(2001, 1, 2)
    orders = [(i, 7, 100.0 + (i * 37) % 101, day + dt.timedelta(days=i // (1 + i % 3))) for i in range(700)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(
        f"{tmpdir_path}/orders.parquet")
    spark.createDataFrame([(7, 3)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmpdir_path}/customer.parquet")
    catalog.load_all()
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmpdir_path}/{t}.parquet/*.parquet'")
    for name in ("A11_corr_matrix", "A12_corr_target", "A12_corr_target_top5"):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, tmpdir_path).collect()]
        want = con.execute(catalog.ORACLE[name]).fetchall()
        assert sorted(map(str, got)) == sorted(map(str, want)), name
        assert any(math.isnan(r[-1]) for r in got)
