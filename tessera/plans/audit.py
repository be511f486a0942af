"""Queries of the audit, each with its SQL."""

from __future__ import annotations

from tessera.config import LEXICON as L
from tessera.operators import audit, history
from tessera.plans import oracle as o
from tessera.plans.queries import QUERIES, SQL, query
from tessera.sources.reports import synthetic_reports

_AFTER = "CASE report_id % 5 WHEN 0 THEN replace({c}, '左', '右') WHEN 1 THEN {c} || '肝脏建议复查。' WHEN 2 THEN replace({c}, '结节', '肿块') WHEN 3 THEN regexp_replace({c}, '^[^。]*。', '') ELSE {c} END"
_FIRST = "'甲' || (report_id % 7)"
SYN = f"""syn AS (SELECT report_id, modality, StudyPart, Sex, applyTable, ReportStr AS beforeReportStr, ConclusionStr AS beforeConclusionStr,
  {_AFTER.format(c='ReportStr')} AS ReportStr, {_AFTER.format(c='ConclusionStr')} AS ConclusionStr, {_FIRST} AS report_doctor,
  CASE WHEN report_id % 11 = 0 THEN '' WHEN report_id % 13 = 0 THEN {_FIRST} ELSE '乙' || (report_id % 3) END AS audit_doctor FROM ({o.REPORTS_SQL}))"""


def dice(a: str, b: str) -> str:
    """Dice coefficient of the distinct character pairs."""
    grams = lambda x: f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1) + 1), lambda i: substr({x}, i, 2)))"
    return f"(2.0 * len(list_intersect({grams(a)}, {grams(b)})) / (len({grams(a)}) + len({grams(b)})))"


def _on(path: str, position: str) -> str:
    return f"list_contains(string_split({path}, '>'), {position})"


_SENTENCES = o.with_(SYN, o.KG, o.sent(audit.VERSIONS), o.ent(), o.exams()).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, st AS MATERIALIZED (SELECT report_id, replace(field, 'before_', '') AS area, CASE WHEN starts_with(field, 'before_') THEN 'before' ELSE 'after' END AS version, sentence,
  arg_min(position, (sentence_index, start, match_no)) AS position, arg_min(path, (sentence_index, start, match_no)) AS path, arg_min(orientation, (sentence_index, start, match_no)) AS orientation,
  max(positive) >= 2 AS positive, max(measure) AS measure, count(*) AS n FROM ent GROUP BY 1, 2, 3, 4),
single AS (SELECT report_id, area, sentence FROM st GROUP BY ALL HAVING count(DISTINCT version) = 1),
un AS (SELECT st.* FROM st JOIN single USING (report_id, area, sentence)),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY report_id, area ORDER BY similarity DESC, before, after) AS rn FROM (
  SELECT b.report_id, b.area, b.sentence AS before, a.sentence AS after, b.positive <> a.positive AS flips,
    round(0.4 * CASE WHEN b.position = a.position THEN 1.0 WHEN {o.related('b.path', 'a.path')} THEN 0.5 ELSE 0.0 END + 0.6 * {dice('b.sentence', 'a.sentence')}, 6) AS similarity
  FROM un b JOIN un a ON b.report_id = a.report_id AND b.area = a.area AND b.version = 'before' AND a.version = 'after') WHERE similarity > {audit.LEAST} AND similarity < 1),
g(report_id, area, k, ub, ua) AS (
  SELECT DISTINCT report_id, area, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM rk
  UNION ALL
  SELECT g.report_id, g.area, k + 1, CASE WHEN list_contains(ub, before) OR list_contains(ua, after) THEN ub ELSE list_append(ub, before) END,
    CASE WHEN list_contains(ub, before) OR list_contains(ua, after) THEN ua ELSE list_append(ua, after) END
  FROM g JOIN rk ON g.report_id = rk.report_id AND g.area = rk.area AND rk.rn = g.k + 1),
chosen AS MATERIALIZED (SELECT c.*, similarity, flips FROM (SELECT report_id, area, unnest(ub) AS before, unnest(ua) AS after FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY report_id, area ORDER BY k DESC) = 1)) c
  JOIN rk USING (report_id, area, before, after))
"""

_COSTS = _SENTENCES + f"""
, total AS (SELECT report_id, area, 20.0 / CASE WHEN sick > 0 THEN sick ELSE greatest(a, b) END AS share FROM (
  SELECT report_id, area, greatest(count(*) FILTER (version = 'before' AND positive), count(*) FILTER (version = 'after' AND positive)) AS sick,
    coalesce(sum(n) FILTER (version = 'before'), 0) AS b, coalesce(sum(n) FILTER (version = 'after'), 0) AS a FROM st GROUP BY 1, 2) WHERE a > 0 AND b > 0),
alone AS (SELECT un.*, EXISTS (SELECT 1 FROM exams e WHERE e.report_id = un.report_id AND ((({_on('un.path', 'e.exam')} OR {_on('e.exam_path', 'un.position')})
    AND (e.exam_side = un.orientation OR e.exam_side IN ('', '双') OR un.orientation IN ('', '双'))) OR ({_on('e.exam_path', "'胸部'")} AND {_on('un.path', "'心脏'")}))) AS inside
  FROM un WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.report_id = un.report_id AND c.area = un.area AND (c.before = un.sentence OR c.after = un.sentence))),
cost AS MATERIALIZED (
  SELECT report_id, area, CASE version WHEN 'after' THEN 'added' ELSE 'deleted' END AS change, sentence, CAST(share * CASE WHEN inside THEN 1.0 ELSE 0.5 END AS DOUBLE) AS cost FROM alone JOIN total USING (report_id, area)
  UNION ALL SELECT report_id, area, 'modified', '"' || before || '" 修改为 "' || after || '"', CAST(CASE WHEN flips THEN share ELSE ceil(round(share * (1 - similarity), 9)) END AS DOUBLE) FROM chosen JOIN total USING (report_id, area)
  UNION ALL SELECT report_id, area, 'side', min(before), 20.0 FROM chosen JOIN total USING (report_id, area)
    WHERE similarity > {audit.SIDE} AND contains(before, '左') <> contains(after, '左') AND contains(before, '右') <> contains(after, '右') GROUP BY 1, 2)
"""


def _missing(field: str) -> str:
    e = f"(SELECT * FROM ent WHERE field = '{field}')"
    return f"""SELECT DISTINCT report_id, exam FROM exams x WHERE NOT {o.has('StudyPart', L.skip_part)} AND report_id IN (SELECT report_id FROM {e})
      AND NOT EXISTS (SELECT 1 FROM {e} e WHERE e.report_id = x.report_id AND {o.related('exam_path', 'path')} AND NOT {o.opposite('exam_side', 'orientation')})"""


def _inverse(field: str) -> str:
    return f"""SELECT DISTINCT report_id, sentence FROM (SELECT x.report_id, e.sentence_index, e.sentence, e.start FROM exams x JOIN ent e ON x.report_id = e.report_id AND e.field = '{field}' AND {o.related('exam_path', 'path')}
      GROUP BY ALL HAVING bool_and({o.opposite('exam_side', 'orientation')}))"""


def _items(change: str, head: str) -> str:
    lines = f"list_sort(list(DISTINCT '- ' || sentence) FILTER (change = '{change}'))"
    return f"CASE WHEN count(*) FILTER (change = '{change}') > 0 THEN '{head}' || chr(10) || array_to_string({lines}, chr(10)) END"


_OLD = "beforeReportStr || beforeConclusionStr"
_QUALITY = _COSTS + f"""
, worse AS (SELECT report_id FROM (({_missing('before_description')}) EXCEPT ({_missing('description')})) UNION SELECT report_id FROM (({_inverse('before_description')}) EXCEPT ({_inverse('description')}))),
{o.long_measures(_OLD)},
long AS (SELECT DISTINCT report_id FROM each),
fixed AS (SELECT report_id FROM (SELECT report_id, measure FROM ent WHERE field = 'before_description' AND measure > 0 EXCEPT SELECT report_id, measure FROM ent WHERE field = 'description' AND measure > 0) WHERE report_id IN (SELECT report_id FROM long)),
spoken AS (SELECT report_id FROM fixed UNION SELECT report_id FROM syn WHERE (Sex IN ('男', 'M') AND {o.has(_OLD, L.female)}) OR (Sex IN ('女', 'F') AND {o.has(_OLD, L.male)})),
bad AS (SELECT report_id, count(*) AS bad FROM (SELECT DISTINCT report_id, sentence FROM st WHERE version = 'before') JOIN syn USING (report_id) WHERE {o.has('sentence', L.nonstandard)} OR (modality = 'MR' AND {o.has('sentence', L.nonstandard_mr)}) GROUP BY 1),
spent AS (SELECT report_id, coalesce(sum(cost) FILTER (area = 'description'), 0) AS d, coalesce(sum(cost) FILTER (area = 'conclusion'), 0) AS c, bool_or(change = 'side') AS side FROM cost GROUP BY 1),
told AS (SELECT report_id, concat_ws(chr(10), {_items('added', '### 新增:')}, {_items('modified', '### 纠正:')}, {_items('deleted', '### 删除:')}) AS explain FROM cost WHERE area = 'conclusion' GROUP BY 1),
state AS (SELECT report_id, bool_or(area = 'description' AND version = 'before') AS hd, bool_or(area = 'conclusion' AND version = 'before') AS hc FROM st GROUP BY 1),
p AS (SELECT syn.report_id,
  CASE WHEN syn.report_id NOT IN (SELECT report_id FROM exams) OR NOT coalesce(hd, false) OR syn.report_id IN (SELECT report_id FROM worse) THEN 0.0 ELSE 20.0 END AS part,
  greatest(0.0, round(20 - coalesce(c, 0), 6)) AS conclusion, greatest(0.0, round(20 - coalesce(d, 0), 6)) AS report,
  CASE WHEN syn.report_id IN (SELECT report_id FROM spoken) OR coalesce(side, false) THEN 0.0 ELSE 20.0 END AS language,
  greatest(0.0, 10 - coalesce(bad, 0) * 2.0) AS terms,
  CASE WHEN report_doctor = '' OR audit_doctor = '' OR report_doctor = audit_doctor OR NOT coalesce(hd, false) OR NOT coalesce(hc, false) THEN 0.0 ELSE 10.0 END AS audit, coalesce(explain, '') AS explain
  FROM syn LEFT JOIN spent USING (report_id) LEFT JOIN state USING (report_id) LEFT JOIN bad USING (report_id) LEFT JOIN told USING (report_id)),
s AS (SELECT *, round(part + conclusion + report + language + terms + audit, 6) AS score FROM p)
SELECT report_id, CAST(part AS DOUBLE) AS part, CAST(conclusion AS DOUBLE) AS conclusion, CAST(report AS DOUBLE) AS report, CAST(language AS DOUBLE) AS language, CAST(terms AS DOUBLE) AS terms, CAST(audit AS DOUBLE) AS audit,
  explain, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 60 THEN 'B' ELSE 'C' END AS grade FROM s"""


def _audited(spark, sf_dir):
    return audit.audit_reports(synthetic_reports(spark, sf_dir))


@query(_QUALITY)
def audit_grade(spark, sf_dir):
    return audit.audit_quality(_audited(spark, sf_dir))


@query(_SENTENCES + "SELECT report_id, area, before, after, similarity, flips FROM chosen")
def audit_match(spark, sf_dir):
    return audit.matched(_audited(spark, sf_dir))


@query(_COSTS + "SELECT report_id, area, change, sentence, round(cost, 6) AS cost FROM cost")
def audit_deductions(spark, sf_dir):
    from pyspark.sql import functions as F

    costs = audit.deductions(_audited(spark, sf_dir))
    return costs.withColumn("cost", F.round("cost", 6))


_LIKE = o.REPORTS + """, f AS (SELECT report_id, 'description' AS field, ReportStr AS t FROM syn UNION ALL SELECT report_id, 'conclusion', ConclusionStr FROM syn),
v AS (SELECT report_id, field, list_filter(string_split(t, '。'), lambda s: s <> '') AS before, list_filter(string_split(CASE report_id % 3 WHEN 0 THEN replace(t, '左', '右') WHEN 1 THEN t || '建议复查。' ELSE t END, '。'), lambda s: s <> '') AS after FROM f),
n AS (SELECT DISTINCT report_id, field, unnest(list_filter(after, lambda x: NOT list_contains(before, x))) AS new FROM v), x AS (SELECT DISTINCT report_id, field, unnest(list_filter(before, lambda x: NOT list_contains(after, x))) AS gone FROM v),
""" + f"""p AS (SELECT report_id, field, new, gone, CASE WHEN new IS NULL OR gone IS NULL THEN 0.0 ELSE round({dice('new', 'gone')}, 6) END AS s FROM n FULL JOIN x USING (report_id, field)),
u AS (SELECT report_id, field, new AS sentence, max(s) AS similarity, 'added' AS label FROM p WHERE new IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT report_id, field, gone, max(s), 'deleted' FROM p WHERE gone IS NOT NULL GROUP BY 1, 2, 3)
SELECT report_id, field, CASE WHEN similarity < 0.5 THEN label ELSE 'modified' END AS change, sentence, CAST(similarity AS DOUBLE) AS similarity FROM u WHERE label = 'added' OR similarity < 0.5"""


@query(_LIKE)
def audit_best_pairs(spark, sf_dir):
    return audit.best_likeness(history.audit_versions(synthetic_reports(spark, sf_dir)))


assert QUERIES["audit_grade"] is audit_grade and "audit_grade" in SQL
