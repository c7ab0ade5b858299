import json

import pytest

from talkledger import config
from talkledger.catalogue import demo_rules
from talkledger.functions import text as T
from talkledger.sources import readers, sinks
from talkledger.streaming.transcripts import stream_reports
from pyspark.sql import functions as F


def test_text_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_text("SPEAKER_00 [1.00s - 2.00s]: hi\n\n there \n")
    (tmp_path / "a.txt").write_text("\n \n")
    (tmp_path / "c.md").write_text("no")
    assert [tuple(r) for r in readers.read_text_folder(spark, str(tmp_path)).collect()] == [("b", "hi\nthere")]
    with pytest.raises(FileNotFoundError):
        readers.read_text_folder(spark, str(tmp_path / "none"))


def test_json_transcripts_and_holdout(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps([{"transcript": "x"}, 5, {"transcript_id": "k", "title": "T", "transcript": "y"}, {"transcript": " "}]))
    assert [(r[0], r[1]) for r in readers.read_incoming(spark, str(p)).collect()] == [("transcript_1", ""), ("k", "T")]
    e = [{"disclaimer_id": "1", "anchor": "a", "label": "Compliant"}, {"disclaimer_id": "1", "anchor": "a", "label": "?"}]
    p.write_text(json.dumps([{"transcript": "x", "expected_labels": e}]))
    assert readers.expected_rows(readers.read_holdout(spark, str(p))).count() == 1
    p.write_text(json.dumps([{"transcript": "x"}]))
    with pytest.raises(ValueError):
        readers.read_holdout(spark, str(p))
    assert readers.read_json_or(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_report_round_trip(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('﻿transcript_id,1,COMPLIANT\na,0.5,"1, 2"\na,0.1,NONE\nb,0.2,NONE\n', encoding="utf-8")
    assert {r["transcript_id"]: sorted(r["labels"]) for r in readers.read_report(spark, str(p)).collect()} == {"a": ["1", "2"], "b": []}


def test_orders_and_names(spark):
    ids = spark.createDataFrame([("10",), ("b",), ("9",)], "x string")
    assert [r[0] for r in ids.orderBy(*T.rule_order(F.col("x"))).collect()] == ["9", "10", "b"]
    dots = spark.createDataFrame([("1.10",), ("1.9",), ("x",)], "x string")
    assert [r[0] for r in dots.orderBy(*T.dotted_order(F.col("x"))).collect()] == ["1.9", "1.10", "x"]
    files = spark.createDataFrame([("a.txt", 1), ("a.txt", 2), ("b", 3)], "name string, pos int")
    assert sorted(r["unique"] for r in readers.distinct_names(files).collect()) == ["a.txt", "a_2.txt", "b"]


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"inference": {"top_k": 9}}')
    assert config.settings(config.load(str(p))).top_k == 9
    assert config.dotted(config.DEFAULTS, "inference.low") == 0.3 and config.dotted({}, "a.b", 1) == 1


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Agent: the of and by\nUser: no")
    stream_reports(spark, str(folder), demo_rules(spark), ["Agent"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("rule_id = '101'").first()["passed"] and out.count() == 6
