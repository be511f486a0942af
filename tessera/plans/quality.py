"""The composite report and its rates, with SQL that puts the checks' own SQL together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import LEXICON as L
from tessera.operators import checks, quality
from tessera.plans import grammar as pg
from tessera.plans import oracle as o
from tessera.plans.queries import SQL, ents, query
from tessera.sources.reports import synthetic_reports

_TYPED = f"syn AS (SELECT report_id, modality, StudyPart, Sex, applyTable, {pg._spoil('ReportStr')} AS ReportStr, {pg._spoil('ConclusionStr')} AS ConclusionStr FROM ({o.REPORTS_SQL}))"
_GATE = {"checked": o.has("modality", L.check_modality)}
_GATE["operated"] = f"{_GATE['checked']} AND NOT {o.has('StudyPart', L.skip_part)}"
_GATE["grown"] = f"{_GATE['checked']} AND NOT contains(StudyPart, '{L.skip_apply}')"
_ITEMS = (
    ("partmissing", "part_missing", "exam", "operated"),
    ("partinverse", "part_inverse", "sentence", "operated"),
    ("special_missing", "special_missing", "missing", ""),
    ("conclusion_missing", "conclusion_missing", "sentence", "grown"),
    ("orient_error", "orient_error", "'[描述]' || description || '；[结论]' || conclusion", "grown"),
    ("contradiction", "contradiction", "neg || '｜' || pos", "checked"),
    ("critical_value", "critical_value", "rule || '｜' || category || '｜' || description", ""),
    ("none_standard_term", "nonstandard_terms", "term", ""),
    ("measure_unit_error", "measure_limit", "measure_text", ""),
    ("apply_orient", "apply_orient", "apply_sentence", ""),
    ("sex_error", "sex_conflict", "sex_error", ""),
    ("RADS", "rads_missing", "rads", ""),
)


def _found() -> str:
    """(report_id, check_name, item) over the typed reports."""
    out = []
    for name, key, item, gate in _ITEMS:
        where = f" WHERE report_id IN (SELECT report_id FROM syn WHERE {_GATE[gate]})" if gate else ""
        out.append(f"SELECT report_id, '{name}' AS check_name, {item} AS item FROM ({SQL[key].replace(o.SYN, _TYPED)}) x{where}")
    out.append(f"SELECT report_id, 'grammer_error', error || '→' || coalesce(suggestion, '?') FROM ({SQL['grammar_errors']}) x")
    return " UNION ".join(f"SELECT * FROM ({x}) y" for x in out)


def _judged() -> str:
    return o.with_(_TYPED) + f""", found AS MATERIALIZED ({_found()}),
v AS (SELECT *, CASE WHEN check_name IN ({', '.join(f"'{c}'" for c in quality.JUDGED)}) THEN (length(item) + report_id) % 10 END AS s FROM found),
act AS (SELECT report_id, check_name, item, CASE WHEN s IS NULL THEN 'keep' WHEN s = 0 THEN 'review' WHEN s = 1 THEN 'drop' WHEN s >= 7 THEN 'keep' WHEN s >= 5 THEN 'weak' ELSE 'drop' END AS action FROM v),
j AS (SELECT report_id, check_name, CASE action WHEN 'weak' THEN '[弱阳性]' || item ELSE item END AS item FROM act WHERE action IN ('keep', 'weak')
  UNION ALL SELECT report_id, check_name, '[待审核]' || count(*) || '项' FROM act WHERE action = 'review' GROUP BY 1, 2)
"""


def _cell(name: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT item) FILTER (check_name = '{name}')), '；'), '') AS {name}"


def _reports(spark, sf_dir):
    return pg.typed(synthetic_reports(spark, sf_dir))


def _grammar(spark, sf_dir):
    e = pg.Lexicons(spark, sf_dir).detected()
    return e.select("report_id", F.concat("error", F.lit("→"), F.coalesce("suggestion", F.lit("?"))).alias("item"))


def _verdicts(found):
    """Verdicts in place of a model's: by the length of a finding and the key of its report."""
    s = F.pmod(F.length("item") + F.col("report_id"), F.lit(10))
    asked = found.where(F.col("check_name").isin(*quality.JUDGED)).withColumn("s", s)
    return asked.select("report_id", "check_name", "item", F.when(F.col("s") > 0, F.col("s") > 1).alias("is_valid"), (F.col("s") / 10.0).alias("confidence"))


def _text(report):
    return report.select("report_id", *(F.coalesce(F.array_join(n, "；"), F.lit("")).alias(n) for n in quality.LISTS))


@query(_judged() + f"SELECT syn.report_id, {', '.join(map(_cell, quality.LISTS))} FROM syn LEFT JOIN j USING (report_id) GROUP BY 1")
def quality_report(spark, sf_dir):
    from tessera.scratch import stored

    r = _reports(spark, sf_dir)
    found = stored(quality.findings(r, grammar=_grammar(spark, sf_dir)))
    return _text(quality.in_rows(r, quality.judged(found, _verdicts(found))))


@query(o.with_(_TYPED) + f", found AS MATERIALIZED ({_found()}), n AS (SELECT check_name, count(DISTINCT report_id) AS n FROM found GROUP BY 1), c(check_name) AS (VALUES {', '.join(f'({o.quote(x)})' for x in quality.LISTS)}) SELECT check_name, round(coalesce(n, 0) / CAST((SELECT count(*) FROM syn) AS DOUBLE), 6) AS rate FROM c LEFT JOIN n USING (check_name)")
def error_rates(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return checks.error_rates(quality.quality_report(r, grammar=_grammar(spark, sf_dir)), list(quality.LISTS))


_FORCED = f"""
, once AS (SELECT report_id, position FROM ent WHERE field = 'description' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT DISTINCT d.report_id, d.sentence AS description, c.sentence AS conclusion FROM ent d JOIN ent c ON d.report_id = c.report_id AND d.field = 'description' AND c.field = 'conclusion' AND {o.related('d.path', 'c.path')}
  AND NOT {o.opposite('d.orientation', 'c.orientation')} AND d.positive >= 2 AND c.positive >= 2 JOIN once ON once.report_id = d.report_id AND once.position = d.position"""


@query(o.ENTITIES + _FORCED)
def forced_match(spark, sf_dir):
    return checks.forced_matches(ents(spark, sf_dir))


@query(o.with_(o.SYN, o.KG, o.sent(("apply",), "sa"), o.ent("a", "sa"), o.exams()) + f"""
SELECT DISTINCT a.report_id, a.position AS part FROM a WHERE a.report_id IN (SELECT report_id FROM exams) AND (a.report_id, a.position) NOT IN (
  SELECT (a.report_id, a.position) FROM a JOIN exams x ON a.report_id = x.report_id AND {o.related('a.path', 'exam_path')} AND NOT {o.opposite('a.orientation', 'exam_side')})""")
def apply_missing(spark, sf_dir):
    from tessera.operators.entities import entities

    r = synthetic_reports(spark, sf_dir)
    return checks.apply_missing(r, entities(r, ("apply",)), checks.exam_parts(r))


@query(o.with_(o.SYN, o.KG, o.sent(("apply",), "sa"), o.ent("a", "sa"), o.exams()) + f"""
, e AS (SELECT DISTINCT report_id, exam, exam_path, exam_side FROM exams WHERE NOT {o.has('StudyPart', L.skip_part)}),
named AS (SELECT DISTINCT e.report_id, exam, exam_side FROM e JOIN a ON a.report_id = e.report_id AND (list_contains(string_split(a.path, '>'), exam) OR list_contains(string_split(exam_path, '>'), a.position)) AND NOT {o.opposite('a.orientation', 'exam_side')})
SELECT report_id, '申请单中缺乏对“' || string_agg(DISTINCT exam_side || exam, ',' ORDER BY exam_side || exam) || '”的检查原因详细描述' AS message
FROM (SELECT DISTINCT report_id, exam, exam_side FROM e) e ANTI JOIN named ON e.report_id = named.report_id AND e.exam = named.exam AND e.exam_side = named.exam_side GROUP BY 1""")
def application_form(spark, sf_dir):
    from tessera.operators.entities import entities

    r = synthetic_reports(spark, sf_dir)
    return checks.application_form(r, entities(r, ("apply",)), checks.exam_parts(r))
