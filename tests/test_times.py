"""Rows that count several times give what as many rows give."""

from tessera.operators import corpus, detect, grammar as g, language_model as lm, vocabulary as v

TEXTS = ["右肺上叶见结节影", "肝脏未见异常", "右肺见结节"]


def test_weighted_sentences_as_repeated_ones(spark):
    rows = spark.createDataFrame([(k, "description", 0, TEXTS[k % 3 if k < 9 else 0]) for k in range(14)], "report_id long, field string, sentence_index int, sentence string")
    each = g.different(rows)
    assert each.count() == 3
    cost = v.word_costs(rows, ["结节", "右肺", "肝脏", "异常"])
    full, few = v.segmented(rows, cost), v.segmented(each, cost)
    for of in (g.token_freq, lambda d: g.run_counts(d, 2, 3), lambda d: lm.train(d, prune=(0, 0, 0, 0))):
        a, b = ({tuple(r) for r in of(d).collect()} for d in (full, few))
        assert a == b and a
    assert cost[""] == v.costs({"结节": 12, "右肺": 12, "肝脏": 4, "异常": 4})[""]
    found = few.join(rows, "sentence").groupBy("sentence").count()
    assert g.of_all(rows, found.withColumnRenamed("count", "n").selectExpr("0 AS report_id", "'' AS field", "0 AS sentence_index", "*")).count() == 14


def test_merged_keeps_what_it_made_of_a_text(spark, monkeypatch):
    asked = []
    structure = detect.scan.structure
    rows = [(k, ("右肺上叶见结节。肝脏未见异常。", "肝脏见囊肿。")[k % 2], "腹部") for k in range(12)]
    reports = spark.createDataFrame(rows, "report_id long, ReportStr string, StudyPart string")
    made = {}
    monkeypatch.setattr(detect, "per_report", lambda r, columns, schema, make: made.update(make=make))
    monkeypatch.setattr(detect.scan, "structure", lambda *a, **k: asked.append(a[0]) or structure(*a, **k))
    detect.merged(reports)
    trie = detect.scan.dictionary()
    for _, desc, part in rows:
        want = [(kind, e.keyword, ">".join(e.paths[0])) for kind, t in (("report", desc), ("title", f"{part}/{desc.split('。')[0]}")) for e in structure(t, trie, title=kind == "title")]
        assert made["make"](desc, part) == want and want
    assert len(asked) == 4


def test_pairs_are_counted_both_ways(spark, monkeypatch):
    monkeypatch.setattr(corpus, "HELD", 2)
    docs = spark.createDataFrame([("A b a b. b A c",), (None,), ("",), ("c c a",)], "text string")
    assert {tuple(r) for r in corpus.pair_counts(docs).collect()} == {("a", "b", 2, 2), ("a", "c", 1, 1)}
