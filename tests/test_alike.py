"""Work that is done once for each different report or rule: the same results as for every one."""

import duckdb
import pytest

from tessera.operators import alike, audit, checks, entities as en, quality
from tessera.plans import texts  # noqa: F401  registers legacy_report
from tessera.plans.queries import QUERIES, SQL

TEXTS = [("右肺上叶见结节，大小约12mm。肝脏未见异常。", "右肺结节。"), ("肝脏见囊肿，大小约31mm。", "肝囊肿。右肺结节。"), ("双肺未见异常。", "双肺未见异常。"), ("", "肝囊肿。")]
PART = {"右肺结节": "肺", "肝囊肿": "肝脏"}


def reports_of(spark, n=24):
    rows = [(k, ("CT", "MR", "CT")[k % 3], ("腹部", "胸部")[k % 2], ("男", "女")[k % 2], *TEXTS[k % 4]) for k in range(n)]
    return spark.createDataFrame([*rows, rows[0], (3, "CT", "腹部", "男", *TEXTS[0])], "report_id long, modality string, StudyPart string, Sex string, ReportStr string, ConclusionStr string")


@pytest.mark.parametrize("gates", [False, True])
def test_rule_counts_as_rule_by_rule(spark, gates):
    reports = reports_of(spark)
    parts = sorted({n for r in en.graph(spark).collect() for n in r["path"].split(">")})
    rules = [(i, d, p, part, least, "", "c") for i, (d, p, part, least) in enumerate([(d, p, part, least) for d in ("CT", ".") for p in ("结节|囊肿", "肝.*囊肿", "[^。]") for part in parts for least in ((0.0, 20.0) if gates else (0.0,))] * 2)]
    table = spark.createDataFrame(rules, "rule int, device string, pattern string, part string, least double, described string, category string")
    want = {}
    for r in checks.critical_values(reports.distinct(), en.entities(reports.distinct()), rules=table).collect():
        want.setdefault(r["rule"], set()).add(r["report_id"])
    got = {r["rule"]: (r["n_reports"], r["first_report"]) for r in checks.rule_counts(reports, table).collect()}
    assert got == {k: (len(v), min(v)) for k, v in want.items()} and got


def test_reports_are_counted_once(spark):
    each = alike.counted(reports_of(spark), ["modality", "ConclusionStr"]).collect()
    assert sum(r["n"] for r in each if r["report_id"] not in (0, 3)) == 22
    assert len(each) < 24 and all(r["n"] == 1 for r in each if r["report_id"] in (0, 3))


def test_digests_tell_null_from_empty(spark):
    rows = spark.createDataFrame([(None, ""), ("", None), ("a|1:b", "c"), ("a", "1:b|c"), ("", ""), ("", "")], "a string, b string")
    assert rows.select(alike.sign("a", "b")).distinct().count() == 5


def test_audit_looks_at_each_half_once(spark):
    reports = audit.audit_reports(reports_of(spark, 60).dropDuplicates(["report_id"]))
    each, members = audit.halves(reports)
    assert members.count() == 120 and each.count() < 60
    s = audit.sentence_table(en.entities(reports, audit.VERSIONS))
    pairs = audit.changed_pairs(s)
    for got, want in ((audit.matched(reports), pairs), (audit.deductions(reports), audit.paragraph_costs(s, pairs, checks.exam_parts(reports)))):
        want = want.select(*got.columns)
        assert got.count() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_long_measures_inside_the_row(spark):
    rows = [("长约100cm、3×900mm，2m", "", 1), ("下肢长约900cm", "x", 2), (None, "99米", 3), ("9000mm2 800ml", "99米，99米", 4)]
    reports = spark.createDataFrame(rows, "ReportStr string, ConclusionStr string, report_id long")
    assert {tuple(r) for r in checks.measure_errors(reports).collect()} >= {(1, "900mm"), (4, "99米")}
    assert not {r["report_id"] for r in checks.measure_errors(reports).collect()} & {2, 3}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("several", [False, True])
def test_work_done_once_is_the_work_on_all(spark, how, several):
    reports = reports_of(spark, 60)
    reports = reports.unionByName(reports.where("report_id = 5").selectExpr("CAST(NULL AS LONG) AS report_id", "* EXCEPT (report_id)")) if several else reports.dropDuplicates(["report_id"])
    seen = []

    def work(r):
        seen.append(r.count())
        return quality.older_lists(r) if how == "left" else checks.conclusion_missing(en.entities(r))

    got = alike.once(reports, ["modality", "ReportStr", "ConclusionStr"], work, how)
    want = work(reports)
    want = want if how == "inner" else reports.select("report_id").join(want, "report_id", "left")
    assert got.count() == want.count() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert seen == ([8, 5, 63] if several else [8, 60])


@pytest.mark.parametrize("repeats", [0, alike.REPEATS])
@pytest.mark.parametrize("name", ["legacy_report", "conclusion_missing"])
def test_repeated_and_missing_ids_as_sql(spark, tmp_path, monkeypatch, name, repeats):
    monkeypatch.setattr(alike, "REPEATS", repeats)
    keys = [(k % 70 if k % 9 else None, k * 7 % 31) for k in range(200)] + [(k, k % 3) for k in range(1000, 1300)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    got = QUERIES[name](spark, str(tmp_path))
    want = duck.sql(SQL[name])
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_the_older_report_is_made_once_for_each_different_one(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(25 * 19 * 2 * k + k % 2, 0) for k in range(50)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = []
    whole = checks.conclusion_missing
    monkeypatch.setattr(checks, "conclusion_missing", lambda e: rows.append(e.select("report_id").distinct().count()) or whole(e))
    for name in ("legacy_report", "conclusion_missing"):
        assert QUERIES[name](spark, str(tmp_path)).select("report_id").distinct().count() == 50
    assert rows == [2, 2]


@pytest.mark.parametrize("times", [1, 8])
def test_reports_that_hardly_repeat_are_not_told_apart(spark, monkeypatch, times):
    signed = []
    whole = alike.different
    monkeypatch.setattr(alike, "different", lambda *a: signed.append(a) or whole(*a))
    reports = spark.createDataFrame([(k, "CT", f"肝脏见囊肿，大小约{30 + k // times}cm。", "") for k in range(48)], "report_id long, modality string, ReportStr string, ConclusionStr string")
    got = {r["report_id"]: (r["conclusion_missing"], r["measure_unit_error"]) for r in quality.older_report(reports).collect()}
    assert len(signed) == (times == 8)
    assert got == {k: ([f"肝脏见囊肿，大小约{30 + k // times}cm"], [f"{30 + k // times}cm"]) for k in range(48)}
