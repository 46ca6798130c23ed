"""T3/T5/T6 state: restated weeks merge from parts, moments follow the stream."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tremor.streaming import state as S
from tremor.streaming.events import stream_events

SCHEMA = "id bigint, time_utc timestamp, mag double, depth_km double, tsunami int, place string, latitude double, longitude double"


def events(first, n, day0, seed, places=400):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 2)
    return [(first + i, base + dt.timedelta(days=day0 + rnd.random() * 6), rnd.choice([None, rnd.gauss(4, 1), rnd.gauss(4, 1)]), rnd.uniform(0, 600),
             rnd.randrange(2), f"place {rnd.randrange(places)}", rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for i in range(n)]


def land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)


def check(rows, want):
    by_week = {}
    for e in want:
        monday_close = e[1].date() + dt.timedelta(days=-e[1].weekday() % 7)
        by_week.setdefault(monday_close, []).append(e)
    assert {r.date for r in rows} == set(by_week)
    for r in rows:
        now = by_week[r.date]
        mags = sorted(e[2] for e in now if e[2] is not None)
        assert r.nb_seismes == len(now) and r.tsunami_sum == sum(e[4] for e in now)
        assert r.mag_max == mags[-1] and r.mag_mean == pytest.approx(sum(mags) / len(mags))
        assert r.depth_mean == pytest.approx(statistics.fmean(e[3] for e in now)) and r.energy_sum == pytest.approx(sum(10 ** (1.5 * m) for m in mags))
        places = len({e[5] for e in now})
        assert abs(r.nb_zones - places) <= S.ZONES_ERROR * places
        assert sum(m < r.mag_median for m in mags) <= (0.5 + S.MEDIAN_RANK_ERROR) * len(mags)
        assert sum(m <= r.mag_median for m in mags) >= (0.5 - S.MEDIAN_RANK_ERROR) * len(mags)


def test_restated_week_merges_from_state_and_replays_change_nothing(spark, tmpdir_path):
    landing, place = f"{tmpdir_path}/landing", f"{tmpdir_path}/state"
    one, late = events(0, 3000, 0, 1), events(3000, 2000, 3, 2, places=900)       # the late file restates the first week
    land(spark, one, f"{landing}/batch=1")
    stream = stream_events(spark, landing, spark.createDataFrame([], SCHEMA).schema, pattern="batch=*")
    check(S.stream_weeks(stream, place).collect(), one)
    land(spark, late, f"{landing}/batch=2")
    check(S.stream_weeks(stream, place).collect(), one + late)
    parts = S.read_parts(spark, place)
    assert sorted(r.batch for r in parts.select("batch").distinct().collect()) == [0, 1]
    # the second run read the late file only: its parts count the late rows and nothing else
    assert parts.where("batch = 1").agg(F.sum("n")).first()[0] == len(late)
    whole = ["date", "nb_seismes", "mag_max", "tsunami_sum", "nb_zones"]                # sums of doubles depend on their order
    before = sorted(S.week_rows(S.read_parts(spark, place)).select(whole).collect())
    S.write_parts(S.week_parts(spark.createDataFrame(late, SCHEMA)), place, 1)    # the batch again
    assert sorted(S.week_rows(S.read_parts(spark, place)).select(whole).collect()) == before
    batch = spark.createDataFrame(one + late, SCHEMA)
    exact = S.exact_weeks(batch, spark.createDataFrame([(before[0].date,)], "date date")).collect()
    assert len(exact) == 1 and [exact[0][c] for c in whole[:4]] == [before[0][c] for c in whole[:4]]
    told = S.sketch_check(S.week_rows(S.read_parts(spark, place)), S.exact_weeks(batch, S.week_rows(S.read_parts(spark, place))), batch).collect()
    assert all(r.zones_error <= S.ZONES_ERROR and r.rank_below <= 0.51 and r.rank_within >= 0.49 for r in told)


def test_parts_merge_in_any_grouping_and_odd_magnitudes(spark):
    rows = events(0, 40, 0, 5) + [(900, dt.datetime(2024, 3, 5), None, None, None, None, None, None), (901, None, 5.0, 1.0, 1, "p", 0.0, 0.0),
                                  (902, dt.datetime(2024, 3, 6), float("nan"), 2.0, 1, "q", 0.0, 0.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = S.week_rows(S.week_parts(frame))
    third = [S.week_parts(frame.where(F.col("id") % 3 == k)) for k in range(3)]
    merged = S.week_rows(S.merge_parts(third[0].unionByName(third[1])).unionByName(third[2]))
    exact = ["date", *[c for c in S.EXACT if c not in ("mag_mean", "depth_mean", "energy_sum")], *S.ESTIMATED]
    assert sorted(map(str, whole.select(exact).collect())) == sorted(map(str, merged.select(exact).collect()))
    last = {r.date: r for r in whole.collect()}[dt.date(2024, 3, 11)]
    assert (last.nb_seismes, last.mag_max, last.mag_median, last.mag_mean, last.nb_zones) == (2, None, None, None, 1)
    assert S.week_rows(S.week_parts(spark.createDataFrame([], SCHEMA))).collect() == []


def test_scales_follow_the_stream(spark, tmpdir_path):
    landing, place = f"{tmpdir_path}/landing", f"{tmpdir_path}/scaled"
    one, two = events(0, 200, 0, 7), [(*e[:6], e[6] / 10, e[7] / 20) for e in events(200, 300, 0, 8)] + [(999, dt.datetime(2024, 1, 3), 1.0, 1.0, 0, "p", None, 3.0)]
    land(spark, one, f"{landing}/batch=1")
    stream = stream_events(spark, landing, spark.createDataFrame([], SCHEMA).schema, pattern="batch=*")

    def assign(rows):
        return rows.select("id", "latitude_sd", "longitude_sd")

    def sd(rows, c):
        return pytest.approx(statistics.pstdev(e[c] for e in rows if e[6] is not None and e[7] is not None))

    got = S.stream_scaled(stream, place, assign).collect()
    assert {(r.latitude_sd, r.longitude_sd) for r in got} == {(got[0].latitude_sd, got[0].longitude_sd)} and got[0].latitude_sd == sd(one, 6)
    land(spark, two, f"{landing}/batch=2")
    got = {r.batch: r for r in S.stream_scaled(stream, place, assign).collect()}
    assert got[0].latitude_sd == sd(one, 6)                                     # what was assigned stays as it was
    assert (got[1].latitude_sd, got[1].longitude_sd) == (sd(one + two, 6), sd(one + two, 7))
    table = S.MomentTable(spark, place)
    again = table.scales(table.advance(spark.createDataFrame(two, SCHEMA), 1)).first()      # a replay finds the version before its own
    assert again.latitude_sd == pytest.approx(got[1].latitude_sd) and table.versions().count() == 2
    flat = S.MomentTable(spark, f"{tmpdir_path}/flat")
    row = flat.scales(flat.advance(spark.createDataFrame([(1, None, None, None, None, None, 5.0, 5.0)] * 3, SCHEMA), 0)).first()
    assert (row.latitude_sd, row.longitude_sd) == (1.0, 1.0)
