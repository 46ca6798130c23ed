"""The prepared catalogue lies in equal parts; rows are sorted before they are scored."""

import datetime

import pytest
from pyspark.sql import functions as F

from tremor import session as S
from tremor.plans import q_impute as Q
from tremor.plans.classification import prepare, train_classifier

SCHEMA = ("id bigint, time_utc timestamp_ntz, mag double, depth_km double, latitude double, longitude double, gap double, rms double, "
          "nst int, dmin double, sig int, tsunami int, type string, net string, place string")


@pytest.fixture(scope="module")
def events(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=7 * i), 2.0 + i % 60 / 10, float(i % 600), float(i * 37 % 180 - 90), float(i * 91 % 360 - 180),
             None if i % 4 == 0 else float(i % 50), None if i % 5 == 0 else i % 9 / 10, i % 30, i % 8 / 4, i % 100, i % 2, "earthquake", "view", f"p{i % 5}")
            for i in range(1200)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def parts(df):
    return sorted(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_prepared_rows_lie_in_equal_parts(spark, events, monkeypatch):
    whole = sorted(map(tuple, prepare(events, ["view"])[0].collect()))
    monkeypatch.setattr(S, "DEAL_ROWS", 100)
    rows, _ = prepare(events, ["view"])
    found = parts(rows)
    cores = spark.sparkContext.defaultParallelism
    assert len(found) == 12 if cores == 4 else len(found) % cores == 0          # 1,200 rows of at most 100
    assert max(found) <= 2 * 1200 / len(found)                                   # one file's part and a join's before
    assert sorted(map(tuple, rows.collect())) == whole


def test_small_tables_stay_as_they_lie_and_one_key_is_dealt(spark):
    same = spark.range(2000).select(F.lit(None).cast("bigint").alias("id"), F.col("id").alias("v")).coalesce(1)
    assert S.deal_evenly(same, S.DEAL_ROWS) is same
    found = parts(S.deal_evenly(same, S.DEAL_ROWS + 1))
    assert len(found) == 2 * spark.sparkContext.defaultParallelism and max(found) < 2 * 2000 / len(found)


def test_rows_are_sorted_before_they_are_scored(spark, events, monkeypatch):
    rows, names = prepare(events, ["view"])
    model = train_classifier(rows, names, num_trees=3, max_depth=3)
    monkeypatch.setattr(Q, "_loaded", lambda *_: (rows, names, model))
    out = Q.q_classify(spark, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    sort = plan.index("Sort [")
    assert "UDF" in plan[:sort] and "UDF" not in plan[sort:]                    # a line above reads the lines below
    got = [(r.time_utc, r.id) for r in out.select("time_utc", "id").collect()]
    assert len(got) == 1200 and got == sorted(got, key=lambda r: (r[0], -r[1]), reverse=True)
