"""Scans, sinks and streams."""

import datetime as dt
import json

import pytest

from inkweave.sources import documents, sinks
from inkweave.streaming import ledgers


def test_json_lines_are_strict_and_may_be_missing(spark, tmp_path):
    assert documents.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n{"a": 2}\n')
    assert documents.json_lines(spark, str(p), "a int").count() == 2
    p.write_text('{"a": 1}\nbroken\n')
    with pytest.raises(Exception):
        documents.json_lines(spark, str(p), "a int").collect()


def test_json_object(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([1]))
    with pytest.raises(ValueError):
        documents.json_object(str(p))
    assert documents.term_rows({"terms": [{"source": "a"}, 3]}) == [{"source": "a"}]


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "pub")
    sinks.publish(spark, {"a": spark.range(2)}, root)
    sinks.publish(spark, {"a": spark.range(3), "b": spark.range(1)}, root)
    assert spark.read.parquet(root + "/a").count() == 3
    broken = spark.range(1).selectExpr("raise_error('no') x")
    with pytest.raises(Exception):
        sinks.publish(spark, {"a": broken}, root)
    assert spark.read.parquet(root + "/a").count() == 3


def test_packets(spark, rows):
    u = spark.createDataFrame([("b1", 1, "u1", "f"), ("b1", 2, "u2", "g"), ("b2", 1, "u1", "f"), ("b2", 2, "u2", "g")], "batch string, pos int, unit_id string, fp string")
    p = sinks.packets(u, "batch", "pos", "fp")
    assert p.select("packet_id").distinct().count() == 1
    assert sinks.new_packets(p, p).count() == 0
    need = spark.createDataFrame([("p1", "u1", "f", "l"), ("p2", "u2", "g", "l")], "packet_id string, unit_id string, fp string, lens string")
    have = spark.createDataFrame([("u1", "f", "l")], "unit_id string, fp string, lens string")
    assert rows(sinks.prunable(need, have)) == [("p1",)]


def test_streams(spark, tmp_path, rows):
    t = dt.datetime(2024, 1, 1)
    data = [("a", "reserve", t), ("b", "reserve", t), ("b", "release", t + dt.timedelta(minutes=1)), ("a", "reserve", t)]
    spark.createDataFrame(data, "k string, what string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ledgers.ledger(spark, str(tmp_path / "in"), "k string, what string, at timestamp")
    assert ledgers.drain(ledgers.without_repeats(s, ["k", "what"], "at", "1 hour"), "t").count() == 3
    live = ledgers.drain(ledgers.live_reservations(s, "k", "what", "at", 7200), "r", "update")
    assert {r["k"]: r["live"] for r in live.collect() if r["expires_us"] != -1 or r["k"] == "b"} == {"a": True, "b": False}
    inv = spark.createDataFrame([("a", t)], "k string, invalidated_at timestamp")
    assert {r["k"] for r in ledgers.drain(ledgers.valid_evidence(s, inv, "k", "at"), "v").collect()} == {"b"}
