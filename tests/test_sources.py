"""Readers and sinks, and the fold that hands sides on."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import text as ft
from tessera.operators import detect, history
from tessera.operators.entities import filled_laterality
from tessera import dictionaries
from tessera.sources import reports, sinks


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("肺\n\n 肝 \n")
    (tmp_path / "a.jsonl").write_text(json.dumps({"text": "x"}) + "\n" + json.dumps({"text": " "}) + "\n")
    (tmp_path / "w.txt").write_text("# note\n肺 12 n\n肝 x v\n胆 3\n")
    (tmp_path / "h.txt").write_text("a\tbc\nd\n")
    (tmp_path / "c.ini").write_text("[s]\nKey=a|b\n")
    d = str(tmp_path)
    assert reports.read_corpus(spark, f"{d}/a.txt").count() == 2
    assert reports.read_corpus(spark, f"{d}/a.jsonl", "jsonl").count() == 1
    assert sorted(map(tuple, reports.read_word_table(spark, f"{d}/w.txt").collect())) == [("肺", 12, "n"), ("胆", 3, "n")]
    assert {tuple(r) for r in reports.read_homophones(spark, f"{d}/h.txt").collect()} == {("a", "b"), ("a", "c")}
    assert dictionaries.read_ini(f"{d}/c.ini") == {"s": {"Key": "a|b"}}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", "t"), ("<c>", "u")], "sentence string, error_type string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_by_error(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("error_type = 't'").count() == 1
    assert [r[0] for r in sinks.markdown_lines(df.orderBy("sentence"), ["sentence"]).collect()] == ["| <c> |", "| a\\|b |"]
    html = sinks.html_rows(df.where("error_type = 'u'").withColumn("phrase", F.lit("c"))).first()["html"]
    assert html == "&lt;<mark>c</mark>&gt;"
    sinks.write_with_statistics(df, str(tmp_path / "s"), "error_type")
    assert spark.read.json(str(tmp_path / "s" / "findings")).count() == 2 and spark.read.json(str(tmp_path / "s" / "statistics")).count() == 3


def test_fold_hands_filled_sides_on(spark):
    sides = ["", "左", "", "", "右", ""]
    rows = [Row(report_id=1, field="d", sentence_index=k, start=0, match_no=0, keyword="肾", path="腹部>肾脏", orientation=s) for k, s in enumerate(sides)]
    out = filled_laterality(spark.createDataFrame(rows)).orderBy("sentence_index")
    assert [r["filled"] for r in out.collect()] == ["左", "左", "左", "左", "右", "右"]


def test_validator_is_asked_once_per_phrase(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "phrase string")
    out = detect.validated(df, lambda b: b.assign(is_valid=True, confidence=0.9, reason="ok"))
    assert out.count() == 3 and out.where("confidence = 0.9").count() == 3
    assert detect.validated(df).where("is_valid IS NULL").count() == 3


def test_model_answers(spark):
    df = spark.createDataFrame([('so: {"ok": true} end',), ("none",)], "t string")
    got = df.select(history.parsed_answer(F.col("t"), "ok boolean").alias("a")).select("a.ok").collect()
    assert {r[0] for r in got} == {True, None}


def test_written_queries():
    import pytest

    with pytest.raises(ValueError):
        history.text_query("肺结节和肝囊肿或肾结石")


def test_text_helpers(spark):
    df = spark.createDataFrame([("1. 肺  a.b,,c",)], "t string")
    t = F.col("t")
    row = df.select(ft.drop_numbering(t).alias("a"), ft.collapse_separators(t).alias("b"), ft.truncate(t, 6).alias("c"), ft.highlight(t, ["肺"]).alias("d")).first()
    assert tuple(row) == ("肺  a.b,,c", "1. 肺  a。b、c", "1. ...", "1. **肺**  a.b,,c")


def test_report_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps({"report_id": "7", "ReportStr": "肝脏增大。", "other": 1}) + "\n")
    row = reports.read_reports_jsonl(spark, str(tmp_path / "r.jsonl")).first()
    assert row["report_id"] == "7" and row["ReportStr"] == "肝脏增大。" and row["Sex"] is None
    (tmp_path / "v.txt").write_text("骶髂关节 n\n肝\n\n骶髂关节\n一二三四五六七八九十一\n")
    assert [r["word"] for r in reports.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()] == ["骶髂关节"]
    spark.range(200).write.parquet(str(tmp_path / "t"))
    assert reports.read_named(spark, str(tmp_path / "t")).count() == 100 and reports.read_named(spark, str(tmp_path / "no")) is None


def test_annotation_json(spark):
    from tessera.operators import texts

    rows = [(1, "d", 0, "肝脏增大，肝脏旧", "肝脏", 0, 2, "增大"), (1, "d", 0, "肝脏增大，肝脏旧", "肝脏", 5, 7, "旧"), (1, "d", 0, "肝脏增大，肝脏旧", "肝脏", 5, 7, "旧"), (1, "d", 1, "脾脏", "脾脏", 0, 2, ""), (1, "d", 2, "x", "肝脏", 0, 9, "y")]
    e = spark.createDataFrame(rows, "report_id long, field string, sentence_index int, sentence string, keyword string, start int, end int, illness string")
    spans, links = texts.annotations(e)
    got = [json.loads(r["json"]) for r in sinks.annotation_json(e, spans, links).collect()]
    assert len(got) == 1 and [(x["id"], x["label"], x["start_offset"], x["end_offset"]) for x in got[0]["entities"]] == [(0, "ANAT", 0, 2), (1, "ANAT", 5, 7), (2, "FIND", 2, 4), (3, "FIND", 7, 8)]
    assert [(x["from_id"], x["to_id"]) for x in got[0]["relations"]] == [(0, 2), (1, 3)]


def test_stored_tables_go_when_released(spark):
    import os

    from tessera import scratch

    with scratch.released():
        df = scratch.stored(spark.range(5))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
