"""Steps that look at each different text once: the same results as row by row, from fewer rows."""

from collections import Counter

import pytest

from tessera.operators import entities as en, knowledge, language_model as lm

ROWS = [(k, "description", k % 3, t) for k in range(30) for t in ("右肺上叶见结节影", "肝脏位于中腹部内侧缘", f"第{k % 2}腰椎体未见异常")]


def test_frequent_mentions_look_at_each_text_once(spark):
    rows = spark.createDataFrame(ROWS, "report_id long, field string, sentence_index int, sentence string")
    each = knowledge.different(rows).collect()
    assert {r["sentence"]: r["times"] for r in each} == Counter(t for *_, t in ROWS) and len(each) == 4
    want = {}
    for r in knowledge.mentions(rows).collect():
        n, first = want.get(r["candidate"], (0, None))
        at = (r["report_id"], r["field"], r["sentence_index"], r["sentence"], r["method"])
        want[r["candidate"]] = (n + 1, at if first is None else min(first, at))
    got = {r["candidate"]: (r["frequency"], tuple(r["first"])) for r in knowledge.frequent(rows, 1).collect()}
    assert got == want


def test_entities_work_out_each_sentence_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(en, "stored", lambda df: kept.append(df) or df)
    rows = [(k, "右肺上叶见结节，大小约12mm。肝脏未见异常。", "右肺结节。") for k in range(20)]
    reports = spark.createDataFrame(rows, "report_id long, ReportStr string, ConclusionStr string")
    out = en.entities(reports)
    assert len(kept) == 1 and kept[0].count() * 20 == out.count() > 0
    every = en._derived(en.sentences(reports), en.DEFAULT).select(*out.columns)
    assert out.exceptAll(every).count() == every.exceptAll(out).count() == 0


@pytest.mark.parametrize("order", [2, 4, 9])
def test_runs_are_counted_by_arrays(order, monkeypatch):
    texts = ["abcab", "a", "\x02ab cd\x03", "字典字", "ab" * 40]
    pieces = [(t, len(t)) for t in texts] + [("abcdefgh", 3)]
    runs, times = lm._counted(pieces, order)
    want = Counter(t[i : i + order] for t, own in pieces for i in range(own))
    assert dict(zip(runs, times.tolist(), strict=True)) == want
