"""Building blocks of the SQL oracles: reports, sentences and entities as common table expressions."""

from __future__ import annotations

from tessera import fixtures as fx
from tessera.config import ASPECTS, COMPLEXITY, LEXICON
from tessera.sources.reports import REPORTS_SQL

L = LEXICON


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quote(pattern)})"


def found(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {quote(pattern)})"


SYN = f"syn AS ({REPORTS_SQL})"
KG = f"kg(keyword, position, path, depth, lo, hi) AS (VALUES {fx.sql_list(fx.kg_rows())})"
_COLUMN = {"description": "ReportStr", "conclusion": "ConclusionStr", "title": "StudyPart", "apply": "applyTable", "before_description": "beforeReportStr", "before_conclusion": "beforeConclusionStr"}


def sent(fields: tuple[str, ...] = ("description", "conclusion"), name: str = "sent") -> str:
    texts = " UNION ALL ".join(f"SELECT report_id, '{f}' AS field, {_COLUMN[f]} AS text FROM syn" for f in fields)
    parts = f"list_filter(string_split_regex(text, {quote(L.sentence_end)}), lambda x: x <> '')"
    return f"""{name} AS (
  SELECT report_id, field, CAST(unnest(range(len(l))) AS INTEGER) AS sentence_index, unnest(l) AS sentence
  FROM (SELECT report_id, field, {parts} AS l FROM ({texts}))
)"""


def _entity_columns() -> tuple[str, str, str]:
    plain = "replace(sentence, '*', '×')"
    no_ml = f"regexp_replace({plain}, '(?i)[0-9]+([.][0-9]+)?(ml|毫升)', '', 'g')"
    unit = "CASE WHEN regexp_matches(lower(x), 'cm|厘米') THEN 10.0 WHEN regexp_matches(lower(x), 'mm|毫米') THEN 1.0 WHEN regexp_matches(lower(x), 'm|米') THEN 1000.0 ELSE 0.0 END"
    mm = f"coalesce(list_max(list_transform({found(no_ml, '(?i)[0-9]+(?:[.][0-9]+)?(?:mm|cm|毫米|厘米|米|m|×)')}, lambda x: TRY_CAST(regexp_extract(x, '[0-9.]+') AS DOUBLE) * CAST({unit} AS DOUBLE))), 0.0)"
    pct = f"coalesce(TRY_CAST(regexp_extract({plain}, '([0-9.]+)[%％]', 1) AS DOUBLE) / 100, 0.0)"
    ml = f"coalesce(TRY_CAST(regexp_extract({plain}, '(?i)([0-9]+(?:[.][0-9]+)?)(?:ml|毫升)', 1) AS DOUBLE), 0.0)"
    return mm, pct, ml


def ent(name: str = "ent", source: str = "sent") -> str:
    """The entity table, in steps: matches, spans and measures, side, polarity, aspects."""
    mm, pct, ml = _entity_columns()
    alt = fx.alternatives()
    ranges = " OR ".join(f"(contains(sentence, {quote(k)}) AND {({'length': 'measure', 'percent': 'percent', 'volume': 'volume'})[p]} > 0 AND {({'length': 'measure', 'percent': 'percent', 'volume': 'volume'})[p]} BETWEEN {lo} AND {hi})" for k, p, lo, hi in fx.NORMAL_MEASURE)
    ill = "trim(regexp_replace(illness, ',现|,拟|,考虑', '', 'g'))"
    absolute = ", ".join(quote(x) for x in L.absolute_illness.split("|"))
    bad = f"CASE WHEN trim(p) IN ({absolute}) THEN true WHEN trim(p) = '' OR {has('trim(p)', '^未见')} THEN false WHEN {has('trim(p)', L.illness)} THEN true ELSE length(trim(p)) > 1 AND NOT {has('trim(p)', L.normal)} END"
    words = f"len(list_filter(string_split_regex({ill}, '[,，]'), lambda p: {bad})) > 0"
    sick = f"CASE WHEN {has('sentence', L.ignore_entity)} THEN false WHEN measure > 0 OR percent > 0 OR volume > 0 THEN NOT ({ranges}) ELSE {words} END"
    aspect = ", ".join(f"CASE WHEN {has('illness', p)} THEN '{n}' END" for n, p in ASPECTS)
    before = "substr(sentence, 1, CAST(start AS BIGINT))"
    near = f"regexp_extract({before}, '^(?:.*[^侧位])?(左|右|双|两)', 1)"
    after = "regexp_extract(substr(sentence, CAST(\"end\" AS BIGINT) + 1), '[(（](左|右|双|两)[侧部]*?[)）]', 1)"
    return f"""{name}_m AS (
  SELECT report_id, field, sentence_index, sentence, CAST(k - 1 AS INTEGER) AS match_no, h[k] AS keyword,
         CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM (SELECT *, {found('sentence', alt)} AS h, string_split_regex(sentence, {quote(alt)}) AS g FROM {source}))
), {name}_s AS (
  SELECT m.*, position, path, depth, lo, hi, CAST(start + length(m.keyword) AS INTEGER) AS "end",
         {mm} AS measure, {pct} AS percent, {ml} AS volume
  FROM {name}_m m JOIN kg ON m.keyword = kg.keyword
), {name}_o AS (
  SELECT *, substr(sentence, CAST("end" AS BIGINT) + 1) AS illness,
         CASE WHEN {has('keyword', L.single_organ)} THEN '' ELSE replace(CASE WHEN {near} <> '' THEN {near} ELSE {after} END, '两', '双') END AS orientation
  FROM {name}_s
), {name}_p AS (SELECT *, {sick} AS sick FROM {name}_o),
{name} AS (
  SELECT * EXCLUDE (sick), CASE WHEN sick AND {has('sentence', L.miss_ignore)} THEN 2 WHEN sick THEN 3 WHEN {has('sentence', L.physiologic)} THEN 1 ELSE 0 END AS positive,
         CASE WHEN len(list_filter([{aspect}], lambda x: x IS NOT NULL)) = 0 THEN ['other_description'] ELSE list_filter([{aspect}], lambda x: x IS NOT NULL) END AS attribute
  FROM {name}_p
)"""


def exams() -> str:
    """Exam parts: the entities of the order's wording."""
    return sent(("title",), "sent_t") + ",\n" + ent("ent_t", "sent_t") + """,
exams AS (SELECT report_id, position AS exam, path AS exam_path, orientation AS exam_side, StudyPart FROM ent_t JOIN syn USING (report_id))"""


def related(a: str, b: str) -> str:
    return f"(starts_with({a} || '>', {b} || '>') OR starts_with({b} || '>', {a} || '>'))"


def opposite(a: str, b: str) -> str:
    return f"(({a} = '左' AND {b} = '右') OR ({a} = '右' AND {b} = '左'))"


def modality(x: str) -> str:
    first = f"CASE WHEN upper({x}) IN ('DX', 'CR', 'XA') OR contains(upper({x}), 'DR') OR contains(upper({x}), 'RF') THEN 'DR' ELSE {x} END"
    second = f"CASE WHEN regexp_matches(upper({first}), 'MR|NM') THEN 'MR' ELSE {first} END"
    third = f"CASE WHEN regexp_matches(upper({second}), 'CT|HOLOGIC') THEN 'CT' ELSE {second} END"
    return f"CASE WHEN ({third}) IN ('DR', 'MR', 'CT', 'MG') THEN {third} ELSE 'CT' END"


def complexity_weight(m: str) -> str:
    return "CASE " + " ".join(f"WHEN {m} = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in COMPLEXITY.items()) + " ELSE 0.0 END"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


REPORTS = with_(SYN)
SENTENCES = with_(SYN, sent())
ENTITIES = with_(SYN, KG, sent(), ent())
EXAMS = with_(SYN, KG, sent(), ent(), exams())


def long_measures(text: str) -> str:
    """Tables runs and each: the lengths of a text of syn, and those beyond their limit as (report_id, unit, number)."""
    end = "(?i)(mm|cm|毫米|厘米|米|m)[230]?$"
    put = f"regexp_replace(replace({text}, '*', '×'), '(?i)[0-9]+([.][0-9]+)?ml', '', 'g')"
    return f"""runs AS (SELECT report_id, regexp_matches({put}, '下肢长度|下肢全长|下肢长约|下肢力线') AS legs, unnest(regexp_extract_all({put}, '(?i)(?:[0-9]+(?:[.][0-9]+)?×)*[0-9]+(?:[.][0-9]+)?(?:mm|cm|毫米|厘米|米|m)[230]?')) AS run FROM syn),
each AS (SELECT * FROM (SELECT report_id, legs, regexp_matches(run, '[230]$') AS tail, lower(regexp_extract(run, '{end}', 1)) AS unit, unnest(regexp_extract_all(regexp_replace(run, '{end}', ''), '[0-9]+(?:[.][0-9]+)?')) AS number FROM runs)
  WHERE CAST(number AS DOUBLE) > CASE WHEN unit IN ('cm', '厘米') THEN {L.cm_max} WHEN unit IN ('mm', '毫米') THEN {L.mm_max} ELSE {L.m_max} END AND NOT ((legs OR tail) AND unit IN ('cm', '厘米', 'mm', '毫米')))"""
