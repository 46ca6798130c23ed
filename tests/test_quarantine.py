"""Broken documents go to the quarantine, good ones beside them are read."""

import json

import pytest

from tremor.sources import quarantine as Q


def feature(i, **more):
    return {"type": "Feature", "id": f"e{i}", "properties": {"mag": 4.5 + i, "place": "p", "time": 1_700_000_000_000 + i, "sig": 10 * i, **more},
            "geometry": {"coordinates": [1.0 * i, 2.0, 33.0]}}


@pytest.fixture()
def folder(tmp_path):
    put = lambda name, data: (tmp_path / "feed" / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    (tmp_path / "feed").mkdir()
    put("good.json", json.dumps({"type": "FeatureCollection", "features": [feature(1), feature(2, novel={"a": [1, 2]}, mag="strong")]}, indent=2))
    put("good2.json", json.dumps({"features": [feature(3), {"id": "short", "properties": None, "geometry": {"coordinates": [5]}}, 7]}))
    put("none.json", json.dumps({"features": []}))
    put("cut.json", json.dumps({"features": [feature(4)]})[:-20])
    put("text.json", "  ==> not json at all")
    put("empty.json", " \n")
    put("list.json", json.dumps([feature(5)]))
    put("other.json", json.dumps({"prediction": 5}))
    put("wrong.json", json.dumps({"features": "many"}))
    put("latin.json", b'{"features": ["\xe9"]}')
    put("huge.json", json.dumps({"features": [feature(i) for i in range(500)]}))
    return tmp_path


def test_broken_documents_are_quarantined_and_the_others_read(spark, folder):
    docs = Q.with_features(Q.read_documents(spark, str(folder / "feed"), max_bytes=5_000))
    reasons = {r.source.rsplit("/", 1)[1]: r.reason for r in Q.quarantined(docs).collect()}
    assert reasons == {"cut.json": "not JSON", "text.json": "not JSON", "empty.json": "empty", "list.json": "not an object", "other.json": "no features",
                       "wrong.json": "no features", "latin.json": "not UTF-8", "huge.json": "too large"}
    counts = {r.reason: r.documents for r in Q.quarantine_counts(docs).collect()}
    assert counts["read"] == 3 and sum(counts.values()) == 11
    rows = {r.id: r for r in Q.read_geojson_safely(spark, str(folder / "feed"), str(folder / "quarantine"), max_bytes=5_000).collect()}
    assert set(rows) == {"e1", "e2", "e3", "short", None}
    assert (rows["e1"].mag, rows["e1"].longitude, rows["e1"].depth_km, rows["e1"].sig) == (5.5, 1.0, 33.0, 10)
    assert rows["e2"].mag is None and rows["e2"].sig == 20                      # a value of another type is missing, the rest of the row is there
    assert (rows["short"].longitude, rows["short"].latitude, rows["short"].mag) == (5.0, None, None)
    kept = spark.read.parquet(str(folder / "quarantine"))
    assert kept.count() == 8 and kept.where("reason = 'not JSON'").count() == 2
    assert {r["head"] is None for r in kept.where("reason = 'too large'").collect()} == {True}


def test_unknown_properties_are_kept(spark, folder):
    rows = Q.read_geojson_safely(spark, str(folder / "feed"), max_bytes=5_000).where("id in ('e1', 'e2')")
    got = {r.id: r.more for r in rows.select("id", Q.unknown_properties().alias("more")).collect()}
    assert got == {"e1": {}, "e2": {"novel": '{"a":[1,2]}'}}
    from pyspark.sql import functions as F
    assert rows.where("id = 'e2'").select(F.try_variant_get("properties", "$.novel.a[1]", "int")).first()[0] == 2
    assert rows.where("id = 'e2'").select(F.try_variant_get("properties", "$.mag", "string")).first()[0] == "strong"


def test_lines_and_an_empty_folder_of_good_ones(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text("\n".join([json.dumps({"features": [feature(1)]}), '{"features": [', "", json.dumps({"features": [feature(2)]})]))
    docs = Q.with_features(Q.read_documents(spark, str(tmp_path / "lines"), lines=True))
    assert sorted(r.id for r in Q.feature_rows(docs).collect()) == ["e1", "e2"]
    assert {r.reason: r.documents for r in Q.quarantine_counts(docs).collect()} == {"read": 2, "not JSON": 1, "empty": 1}
    small = Q.with_features(Q.read_documents(spark, str(tmp_path / "lines"), lines=True, max_bytes=20))
    assert {r.reason: r.documents for r in Q.quarantine_counts(small).collect()} == {"too large": 2, "not JSON": 1, "empty": 1}
    assert Q.feature_rows(small).collect() == []


def test_documents_are_parsed_once_for_events_and_quarantine(spark, folder, monkeypatch):
    """The quarantine and the events read what one pass has parsed."""
    parsed, written = [], []
    monkeypatch.setattr(Q, "write_quarantine", lambda documents, place: written.append(documents))
    rows = Q.read_geojson_safely(spark, str(folder / "feed"), str(folder / "quarantine"), max_bytes=5_000)
    for df in (rows, Q.quarantined(written[0])):
        parsed.append("parse_json" in df._jdf.queryExecution().optimizedPlan().toString())
    assert parsed == [False, False]
    assert {r.id for r in rows.collect()} == {"e1", "e2", "e3", "short", None}


def test_what_is_an_object(spark, tmp_path):
    (tmp_path / "kinds").mkdir()
    texts = [' \t{"features": []}', "{}", "[{}]", '"{"', "7", "null", "true", '{"a": 1', "\u00a0{}"]
    (tmp_path / "kinds" / "a.jsonl").write_text("\n".join(texts))
    docs = Q.with_features(Q.read_documents(spark, str(tmp_path / "kinds"), lines=True))
    got = {r.text: r.reason for r in docs.select("text", "reason").collect()}
    assert [got[t] for t in texts] == [None, "no features", *["not an object"] * 5, "not JSON", "not JSON"]
    assert "schema_of_variant" not in docs._jdf.queryExecution().optimizedPlan().toString()
