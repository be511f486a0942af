"""Queries that SQL can't express, against naive versions on plain rows, and worked cases."""

import difflib
import html
import os
import re

import pytest
from pyspark.sql import functions as F

from tessera.config import LEXICON
from tessera.functions import scan
from tessera.operators import audit, checks, detect, extra, grammar, quality, texts
from tessera.operators import entities as en
from tessera.plans import texts as _texts  # noqa: F401  registers its queries
from tessera.plans.queries import QUERIES
from tessera.sources.reports import synthetic_reports

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't there")
REPORT = "report_id long, modality string, StudyPart string, Sex string, applyTable string, ReportStr string, ConclusionStr string"


@pytest.fixture(scope="module")
def reports(spark):
    return synthetic_reports(spark, SF).where("report_id % 4 = 1").cache()


def test_sides_are_handed_on(spark, reports):
    ents = en.entities(reports).cache()
    got = {(r["report_id"], r["field"], r["sentence_index"], r["start"]): r["filled"] for r in en.filled_laterality(ents).collect()}
    groups = {}
    for r in ents.orderBy("sentence_index", "start", "match_no").collect():
        groups.setdefault((r["report_id"], r["field"]), []).append(r)
    for key, rows in groups.items():
        out = []
        for i, r in enumerate(rows):
            side = r["orientation"]
            if not side and re.search(LEXICON.paired_organ, r["path"]):
                side = next((x for x in reversed(out) if x), "") or next((x["orientation"] for x in rows[i + 1 : i + 3] if x["orientation"]), "")
            out.append(side)
            assert got[*key, r["sentence_index"], r["start"]] == side


def test_corrections_by_hand(spark):
    rows = [(1, "d", 0, "甲乙丙丁戊"), (1, "d", 1, "没有"), (2, "d", 0, "一二三四五六")]
    found = [(1, "d", 0, 1, 3, "XY"), (1, "d", 0, 4, 5, ""), (2, "d", 0, 0, 4, "A"), (2, "d", 0, 2, 5, "B"), (2, "d", 0, 5, 6, None)]
    a = spark.createDataFrame(rows, "report_id long, field string, sentence_index int, sentence string")
    b = spark.createDataFrame(found, "report_id long, field string, sentence_index int, start int, stop int, suggestion string")
    assert {tuple(r) for r in grammar.corrected(a, b).collect()} == {(1, "d", 0, "甲XY丁"), (2, "d", 0, "一二B六")}


def test_corrected_reports(spark):
    from tessera.plans import grammar as pg

    x = pg.Lexicons(spark, SF)
    found = x.detected().where("suggestion IS NOT NULL").collect()
    text = {(r["report_id"], r["field"], r["sentence_index"]): r["sentence"] for r in x.rows.collect()}
    spans = {}
    for r in found:
        spans.setdefault((r["report_id"], r["field"], r["sentence_index"]), []).append(r)
    want = {}
    for key, rs in spans.items():
        t, edge = text[key], len(text[key])
        for r in sorted(rs, key=lambda r: -r["start"]):
            if r["stop"] <= edge:
                t, edge = t[: r["start"]] + r["suggestion"] + t[r["stop"] :], r["start"]
        want[key] = t
    got = {(r["report_id"], r["field"], r["sentence_index"]): r["corrected"] for r in QUERIES["corrected_reports"](spark, SF).collect()}
    assert got == want and len(got) > 100


def test_highlights_by_hand(spark, reports):
    sent = en.sentences(reports, ("description",))
    marks = extra.name_places(sent, spark).select(F.concat_ws(":", "report_id", "sentence_index").alias("key"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("end"), (3 - F.least(F.length("keyword"), F.lit(2))).alias("priority"))
    groups = {}
    for r in marks.collect():
        groups.setdefault(r["key"], []).append((r["start"], r["priority"], r["end"]))
    want = set()
    for key, ms in groups.items():
        kept = []
        for m in sorted(ms):
            if kept and m[0] < kept[-1][2]:
                if m[1] < kept[-1][1]:
                    kept[-1] = m
            else:
                kept.append(m)
        want |= {(key, s, e, p) for s, p, e in kept}
    assert {tuple(r) for r in extra.kept_highlights(marks, "key").collect()} == want


def test_html_by_hand(spark, reports):
    names = "|".join(sorted(map(re.escape, scan.dictionary().entries), key=lambda n: -len(n)))
    for r in reports.join(detect.highlighted(reports), "report_id").limit(200).collect():
        want, at = [], 0
        for m in re.finditer(names, r["ReportStr"]):
            want += [html.escape(r["ReportStr"][at : m.start()]), f'<span class="part">{html.escape(m.group())}</span>']
            at = m.end()
        assert r["html"] == "".join(want) + html.escape(r["ReportStr"][at:])


def test_clauses_by_hand(spark):
    cases = {
        "肝脏形态规整，表面光滑，胆囊壁增厚": [("肝脏形态规整,表面光滑", "肝脏"), ("胆囊壁增厚", "胆囊")],
        "建议复查，肝脏增大": [("肝脏增大", "肝脏")],
        "IM20层面，肝脏见结节": [("IM20层面", ""), ("肝脏见结节", "肝脏")],
        "左肺下叶见结节，IM30，胆囊结石": [("左肺下叶见结节,IM30", "肺下叶"), ("胆囊结石", "胆囊")],
        "脾脏见灶se3，胆囊清楚": [("脾脏见灶se3,胆囊清楚", "脾脏；胆囊")],
        "未见异常": [("未见异常", "")],
    }
    table = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "report_id long, ReportStr string")
    got = {}
    for r in detect.clauses(table).collect():
        got.setdefault(r["report_id"], []).append((r["clause"], r["keywords"]))
    assert list(got[i] for i in range(len(cases))) == list(cases.values())


def test_findings_worked_cases():
    trie = scan.dictionary()
    of = lambda t: [(e.keyword, e.illness, e.positive) for e in scan.structure(t, trie)]
    assert of("肝脏、胆囊未见明显异常。") == [("肝脏", "未见明显异常", 0), ("胆囊", "未见明显异常", 0)]
    assert of("胆囊壁增厚。") == [("胆囊", "壁增厚", 3)]
    assert of("胆囊增大伴脾脏肿大。") == [("胆囊", "增大", 3), ("脾脏", "肿大", 3)]
    assert of("老年脾脏形态规整。") == [("脾脏", "形态规整", 1)]
    assert of("局部伪影，心脏增大。")[0][0] == "心脏"
    assert of("压迫肝脏。") == [("肝脏", "压迫肝脏", 3)]


def test_polarity_agrees_between_the_two_ways(spark, reports):
    """On sentences of one clause with one entity the relational cascade and the one on plain values agree."""
    trie = scan.dictionary()
    seen = 0
    for r in en.entities(reports).select("sentence", "keyword", "positive", "measure", "percent", "volume").distinct().collect():
        es = scan.structure(r["sentence"], trie)
        if len(es) == 1 and not re.search("[，,]", r["sentence"]) and not (r["measure"] or r["percent"] or r["volume"]) and r["sentence"].startswith((r["keyword"], "左", "右", "双")):
            seen += 1
            assert es[0].positive == r["positive"], r["sentence"]
    assert seen > 15


def test_disambiguation_worked_cases():
    e = lambda paths, axis, **k: scan.Entity("x", 0, 1, [tuple(p.split(">")) for p in paths], axis, **k)
    two = e(["胸部>肺>肺上叶", "颈部>甲状腺"], [(310.0, 340.0), (210.0, 220.0)])
    chest = e(["胸部"], [(300.0, 400.0)])
    lung = e(["胸部>肺"], [(310.0, 370.0)])
    assert scan.disambiguate(two, [], [chest]).paths == [("胸部", "肺", "肺上叶")]
    assert scan.disambiguate(two, [lung], []).paths == [("胸部", "肺", "肺上叶")]
    assert scan.disambiguate(two, [], []).paths == [("胸部", "肺", "肺上叶")]  # the deepest
    spine = e(["盆腔>卵巢", "脊柱>腰椎"], [(520.0, 550.0), (430.0, 500.0)], sentence="腰椎附件骨质增生")
    assert scan.disambiguate(spine, [], []).paths == [("脊柱", "腰椎")]
    same = e(["a>b", "c>d"], [(1.0, 2.0), (1.0, 2.0)])
    assert len(scan.disambiguate(same, [], []).paths) == 2


def test_merging_worked_cases():
    e = lambda k, a, b, p, **x: scan.Entity(k, a, b, [tuple(p.split(">"))], [(0.0, 1.0)], **x)
    names = lambda es, **x: [y.keyword for y in scan.merge(es, **x)]
    assert names([e("L5/S1", 0, 5, "脊柱>L5/S1"), e("L5", 0, 2, "脊柱>L5")]) == ["L5/S1"]
    liver, right, gall = e("肝脏", 0, 2, "腹部>肝脏"), e("肝右叶", 3, 6, "腹部>肝脏>肝右叶"), e("胆囊", 7, 9, "腹部>胆囊")
    assert names([liver, right, gall]) == ["肝右叶", "胆囊"]
    assert names([liver, right, gall], title=True, text="肝脏/肝右叶/胆囊") == ["肝脏", "胆囊"]
    assert names([liver, right, gall], title=True, text="肝脏 肝右叶 胆囊") == ["肝右叶", "胆囊"]
    left = e("肝右叶", 3, 6, "腹部>肝脏>肝右叶", orientation="左")
    assert names([e("肝脏", 0, 2, "腹部>肝脏", orientation="右"), left]) == ["肝脏", "肝右叶"]
    assert names([liver, liver]) == ["肝脏"]


def test_best_clauses_by_hand(spark, reports):
    """Against a plain search that measures every clause in full."""
    for r in reports.select("report_id", "ReportStr").join(detect.best_clauses(reports), "report_id").limit(300).collect():
        best = 0.0
        for c in (x.strip() for x in re.split("[，,。；;！？、\n\r]", r["ReportStr"])):
            if not c:
                continue
            share = len(set(c) & set(r["sentence"])) / len(set(c) | set(r["sentence"]))
            ratio = 1.0 if c == r["sentence"] else share if share < 0.3 else difflib.SequenceMatcher(None, c, r["sentence"]).ratio()
            best = max(best, min(1.0, ratio + 0.05 * (c[:2] == r["sentence"][:2] and c != r["sentence"])))
        assert r["similarity"] == pytest.approx(best, abs=1e-6)


def test_written_out_numbers(spark):
    want = {0: "腰3椎、腰4椎、腰5椎", 1: "颈5/颈6", 2: "胸3、胸4、胸5", 3: "第1肋、第2肋、第3肋", 4: "腰5/骶1", 5: "未见骨折"}
    for r in QUERIES["spine_rib_expand"](spark, SF).limit(400).collect():
        assert want[r["report_id"] % 6] in r["text"], r["text"]


def test_structured_entities_are_the_steps(spark, reports):
    rows = reports.limit(100).collect()
    got = {}
    for r in detect.structured_entities(reports).collect():
        got.setdefault((r["report_id"], r["field"]), []).append((r["text_index"], r["keyword"], r["orientation"], r["positive"]))
    trie = scan.dictionary()
    for r in rows:
        exams = scan.structure(r["StudyPart"], trie, title=True)
        es = scan.structure(r["ReportStr"], trie, exams)
        assert sorted(got.get((r["report_id"], "description"), [])) == [(k, e.keyword, e.orientation, e.positive) for k, e in enumerate(es)]
        spans = [n for n, _, _ in trie.spans(r["ReportStr"])]
        assert len(es) <= len(spans)


def test_verdicts_are_merged(spark):
    found = spark.createDataFrame([(1, "sex_error", x) for x in "abcdef"] + [(2, "partmissing", "p")], "report_id long, check_name string, item string")
    told = spark.createDataFrame([(1, "sex_error", "a", True, 0.7), (1, "sex_error", "b", True, 0.5), (1, "sex_error", "c", True, 0.4), (1, "sex_error", "d", False, 0.9), (1, "sex_error", "e", None, None)], "report_id long, check_name string, item string, is_valid boolean, confidence double")
    got = {tuple(r) for r in quality.judged(found, told).collect()}
    assert got == {(1, "sex_error", "a"), (1, "sex_error", "[弱阳性]b"), (1, "sex_error", "f"), (1, "sex_error", "[待审核]1项"), (2, "partmissing", "p")}


def test_report_gates(spark):
    rows = [(1, "CT", "胸部平扫", "女", "", "肝右叶见结节影。", "前列腺增生。"), (2, "US", "胸部平扫", "女", "", "肝右叶见结节影。", "未见异常。"), (3, "CT", "胸部手术", "女", "", "肝右叶见结节影。", "未见异常。"), (4, "CT", "骨龄", "女", "", "肝右叶见结节影。", "未见异常。"), (5, "CT", "", None, None, "", "")]
    got = {r["report_id"]: r for r in quality.quality_report(spark.createDataFrame(rows, REPORT)).collect()}
    assert got[1]["partmissing"] == ["胸部"] and got[1]["conclusion_missing"] == ["肝右叶见结节影"] and got[1]["sex_error"]
    assert got[2]["partmissing"] is None and got[2]["conclusion_missing"] is None
    assert got[3]["partmissing"] is None and got[3]["conclusion_missing"]
    assert got[4]["conclusion_missing"] is None
    assert all(v is None for k, v in got[5].asDict().items() if k != "report_id")


def test_audit_odd_rows(spark):
    schema = "report_id long, modality string, StudyPart string, Sex string, applyTable string, beforeReportStr string, beforeConclusionStr string, ReportStr string, ConclusionStr string, report_doctor string, audit_doctor string"
    rows = [(1, "CT", "上腹部增强", "男", "", "肝脏见结节。", "肝脏结节。", "肝脏见结节。", "肝脏结节。", "a", "b"), (2, "CT", "上腹部增强", "男", "", "左肾见结石。", "左肾结石。", "右肾见结石。", "右肾结石。", "a", "a"), (3, "CT", "", "男", "", "", "", "", "", "", "")]
    got = {r["report_id"]: r for r in audit.audit_quality(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["score"], got[1]["grade"], got[1]["explain"]) == (100.0, "A", "")
    assert got[2]["language"] == 0.0 and got[2]["report"] == 0.0 and got[2]["audit"] == 0.0 and got[2]["grade"] == "C"
    assert got[3]["part"] == 0.0 and got[3]["conclusion"] == 20.0
    assert audit.audit_quality(spark.createDataFrame([], schema)).count() == 0


def test_small_text_operators(spark):
    df = spark.createDataFrame([("约3cm(", "{'ok': True, }"), ("x", "nothing"), (None, None)], "t string, a string")
    assert [r[0] for r in df.select(texts.safe_replace(F.col("t"), "(", "!")).collect()] == ["约3cm(", "x", None]
    assert [r[0] for r in df.select(texts.safe_replace(F.col("t"), "[0-9]", "!")).collect()] == ["约!cm(", "x", None]
    assert [r[0] for r in df.select(texts.repaired(F.col("a"))).collect()][0] == '{"ok": true}'
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    assert detect.enriched(nodes).where("description IS NULL").count() == 3
    assert detect.enriched(nodes, lambda b: b.assign(description="d")).where("description = 'd'").count() == 3
    assert checks.illness_similarity is not None


def test_lengths_that_are_spared(spark):
    rows = [(1, "肿块约25cm。", ""), (2, "下肢全长约80cm。", ""), (3, "面积约30cm2。", ""), (4, "肿块约25×3cm。", ""), (5, "腹水约500ml。", ""), (6, "长约3m，下肢力线正常。", ""), (7, "约400mm", "")]
    table = spark.createDataFrame(rows, "report_id long, ReportStr string, ConclusionStr string")
    assert sorted(map(tuple, checks.measure_errors(table).collect())) == [(1, "25cm"), (4, "25cm"), (6, "3m"), (7, "400mm")]
