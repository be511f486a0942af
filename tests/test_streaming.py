"""A stream of reports gives the findings of the batch."""

import json

from tessera.operators import checks
from tessera.streaming import reports as streaming


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"report_id": str(k), "ReportStr": "前列腺增生。", "ConclusionStr": "子宫肌瘤。", "StudyPart": "盆腔", "Sex": s, "modality": "CT", "applyTable": ""} for k, s in enumerate(("男", "女", "F", ""))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = streaming.read_reports(spark, str(tmp_path / "in"))
    streaming.check_stream(stream, checks.sex_conflicts, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("report_id", "sex_error")
    want = checks.sex_conflicts(spark.read.schema(streaming.REPORT).json(str(tmp_path / "in")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3


def test_windows(spark):
    spark.sql("SELECT timestamp'2024-01-01 00:30:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'a'").createOrReplaceTempView("ev")
    assert streaming.counts_by_window(spark.table("ev")).count() == 2
