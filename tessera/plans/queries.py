"""The registered queries of the engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.config import LEXICON as L
from tessera.functions import text as ft
from tessera.operators import checks, corpus, entities as en, extra
from tessera.plans import oracle as o
from tessera.scratch import stored
from tessera.sources.reports import synthetic_reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.entities(synthetic_reports(spark, sf_dir))


# --- report rules -----------------------------------------------------------------

_BOTH = "ReportStr || ConclusionStr"


def _words(p: str) -> str:
    return f"array_to_string(list_sort(list_distinct({o.found(_BOTH, p)})), '；')"


@query(o.REPORTS + f"""
SELECT report_id, sex_error FROM (SELECT report_id, CASE
  WHEN Sex IN ('男', 'M') AND {o.has(_BOTH, L.female)} THEN '男性报告中出现：' || {_words(L.female)}
  WHEN Sex IN ('女', 'F') AND {o.has(_BOTH, L.male)} THEN '女性报告中出现：' || {_words(L.male)} END AS sex_error FROM syn)
WHERE sex_error IS NOT NULL""")
def sex_conflict(spark, sf_dir):
    return checks.sex_conflicts(synthetic_reports(spark, sf_dir))


@query(o.REPORTS + """
SELECT report_id, rads FROM (SELECT report_id, CASE
  WHEN modality IN ('MG', 'DR', 'DX', 'MR') AND contains(StudyPart, '乳腺') AND NOT regexp_matches(ConclusionStr, '(?is)BI.*RADS') THEN '缺少BI-RADS分类'
  WHEN modality = 'MR' AND contains(StudyPart, '前列腺') AND NOT regexp_matches(ConclusionStr, '(?is)PI.*RADS') THEN '缺少PI-RADS分类' END AS rads FROM syn)
WHERE rads IS NOT NULL""")
def rads_missing(spark, sf_dir):
    return checks.rads_missing(synthetic_reports(spark, sf_dir))


def _lost(p: str, label: str, mods: str) -> str:
    return f"CASE WHEN {o.has('StudyPart', p)} AND NOT {o.has('ReportStr', p)} AND modality IN ({mods}) THEN '{label}' END"


@query(o.REPORTS + f"""
SELECT report_id, missing FROM (SELECT report_id, unnest([
  CASE WHEN len(list_filter(string_split_regex({_BOTH}, {o.quote(L.sentence_end)}), lambda s: {o.has('s', L.enhance_text)} AND NOT {o.has('s', L.enhance_excuse)})) > 0
        AND NOT {o.has('StudyPart', L.enhance_order)} AND modality IN ('CT', 'MR') THEN '出现增强描述' END,
  CASE WHEN {o.has('StudyPart', L.enhance_order)} AND NOT {o.has('ReportStr', L.enhance_text + '|' + L.perfusion)} AND len({o.found(_BOTH, '动脉')}) < 4
        AND ((modality = 'CT' AND len({o.found(_BOTH, '静脉')}) < 2) OR (modality = 'MR' AND NOT contains(StudyPart, '平扫'))) THEN '增强未描述' END,
  {_lost(L.diffusion, '弥散成像未描述', "'MR'")}, {_lost(L.susceptibility, '磁敏感成像未描述', "'MR'")},
  {_lost(L.perfusion, '灌注成像未描述', "'MR', 'CT'")}, {_lost(L.spectroscopy, '波谱成像未描述', "'MR'")}]) AS missing
  FROM syn WHERE {o.has('modality', L.check_modality)}) WHERE missing IS NOT NULL""")
def special_missing(spark, sf_dir):
    return checks.special_missing(synthetic_reports(spark, sf_dir))


@query(o.REPORTS + f"""
SELECT report_id, unnest(list_distinct(list_concat({o.found(_BOTH, L.nonstandard)},
  CASE WHEN modality = 'CT' THEN {o.found(_BOTH, L.nonstandard_ct)} WHEN modality = 'MR' THEN {o.found(_BOTH, L.nonstandard_mr)} ELSE [] END))) AS term FROM syn""")
def nonstandard_terms(spark, sf_dir):
    return checks.nonstandard_terms(synthetic_reports(spark, sf_dir))


@query(o.REPORTS + f", {o.long_measures(_BOTH)} SELECT DISTINCT report_id, number || unit AS measure_text FROM each")
def measure_limit(spark, sf_dir):
    return checks.measure_errors(synthetic_reports(spark, sf_dir))


@query(o.REPORTS + f"SELECT modality, {o.modality('modality')} AS normal, count(*) AS n FROM syn GROUP BY 1, 2")
def modality_map(spark, sf_dir):
    r = synthetic_reports(spark, sf_dir)
    return r.groupBy("modality", checks.modality(F.col("modality")).alias("normal")).agg(F.count("*").alias("n"))


@query(o.REPORTS + f"SELECT report_id, {o.has('modality', L.check_modality)} AS checked, contains(StudyPart, '手术') AS skip_part FROM syn")
def modality_gate(spark, sf_dir):
    r = synthetic_reports(spark, sf_dir)
    return r.select("report_id", F.col("modality").rlike(L.check_modality).alias("checked"), F.contains("StudyPart", F.lit("手术")).alias("skip_part"))


# --- text operators ----------------------------------------------------------------

@query(r"""
SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS sentence_index, unnest(l) AS sentence
FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n\r]*[^.!?\n\r ][^.!?\n\r]*') AS l FROM documents)""")
def sentence_split(spark, sf_dir):
    parts = ft.all_of(F.col("text"), "[^.!?\\n\\r]*[^.!?\\n\\r ][^.!?\\n\\r]*")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("sentence_index", "sentence"))


@query("""
SELECT gram, count(*) AS n FROM (SELECT substr(w, i, 3) AS gram FROM (SELECT w, unnest(range(1, length(w) - 1)) AS i
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ一-鿿]+')) AS w FROM documents) WHERE length(w) >= 3))
GROUP BY gram HAVING count(*) >= 5""".replace("\\u4e00-\\u9fff", "一-鿿"))
def ngram_counts(spark, sf_dir):
    return corpus.ngram_counts(corpus.words(table(spark, sf_dir, "documents")), 3, 5, "word")


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]')) AS ch FROM documents) GROUP BY ch ORDER BY n DESC, ch LIMIT 20")
def char_topn(spark, sf_dir):
    return corpus.char_topn(table(spark, sf_dir, "documents"), 20)


_LEN = lambda p: f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT)"


@query(rf"SELECT doc_id, CAST(length(text) AS BIGINT) AS total_chars, {_LEN('[一-龥]')} AS chinese_chars, {_LEN('[a-zA-Z]')} AS english_chars, {_LEN('[0-9]')} AS digits, {_LEN('[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]')} AS spaces, {_LEN(chr(92) + 'n')} AS line_breaks FROM documents")
def text_stats(spark, sf_dir):
    return corpus.text_stats(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, {o.quote(p)})) AS BIGINT) AS n_{n}" for n, p in ft.COMMON_PATTERNS.items()) + " FROM documents")
def pattern_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(ft.count_of(F.col("text"), p).alias(f"n_{n}") for n, p in ft.COMMON_PATTERNS.items()))


@query(r"SELECT doc_id, length(trim(text)) >= 2 AND CAST(len(regexp_extract_all(text, '[^A-Za-z0-9_À-ɏ一-龥\s]')) AS DOUBLE) / greatest(length(text), 1) <= 0.5 AS valid FROM documents")
def valid_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ft.valid_text(F.col("text")).alias("valid"))


@query("SELECT doc_id, regexp_matches(text, '[;,，.。]{2}') AS doubled FROM documents")
def punct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ft.doubled_punctuation(F.col("text")).alias("doubled"))


@query("""SELECT order_id, expanded FROM (SELECT o_orderkey AS order_id, array_to_string(list_transform(range(1 + o_orderkey % 3, 1 + o_orderkey % 3 + 1 + o_custkey % 4), lambda i: '腰' || i), '、') AS expanded FROM orders)""")
def part_ranges(spark, sf_dir):
    first = (1 + F.col("o_orderkey") % 3).cast("int")
    names = ft.expand_range(first, (first + F.col("o_custkey") % 4).cast("int"), "腰")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.array_join(names, "、").alias("expanded"))


# --- entities ----------------------------------------------------------------------

@query(o.ENTITIES + "SELECT keyword, field, count(*) AS n FROM ent GROUP BY 1, 2")
def dict_match(spark, sf_dir):
    return ents(spark, sf_dir).groupBy("keyword", "field").agg(F.count("*").alias("n"))


@query(o.ENTITIES + """SELECT report_id, field, sentence_index, start, "end", keyword, round(measure, 6) AS measure, round(percent, 6) AS percent, round(volume, 6) AS volume FROM ent""")
def measure_extract(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return ents(spark, sf_dir).select("report_id", "field", "sentence_index", "start", "end", "keyword", r("measure"), r("percent"), r("volume"))


@query(o.ENTITIES + "SELECT report_id, field, sentence_index, keyword, positive FROM ent")
def positivity_levels(spark, sf_dir):
    return ents(spark, sf_dir).select("report_id", "field", "sentence_index", "keyword", "positive")


@query(o.ENTITIES + "SELECT report_id, field, sentence_index, keyword, array_to_string(attribute, ',') AS attribute FROM ent")
def aspects(spark, sf_dir):
    return ents(spark, sf_dir).select("report_id", "field", "sentence_index", "keyword", F.array_join("attribute", ",").alias("attribute"))


@query(o.ENTITIES + "SELECT report_id, field, sentence_index, keyword, orientation FROM ent")
def laterality(spark, sf_dir):
    return ents(spark, sf_dir).select("report_id", "field", "sentence_index", "keyword", "orientation")


@query(o.ENTITIES + "SELECT report_id, field, keyword, CAST(row_number() OVER (PARTITION BY report_id, field ORDER BY sentence_index, start, match_no) - 1 AS INTEGER) AS text_index FROM ent")
def entity_numbering(spark, sf_dir):
    return en.numbered(ents(spark, sf_dir)).select("report_id", "field", "keyword", "text_index")


_FILL = o.ENTITIES.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, z AS MATERIALIZED (SELECT report_id, field, sentence_index, start, keyword, orientation, regexp_matches(path, '{L.paired_organ}') AS paired, row_number() OVER w AS rn,
  CASE WHEN coalesce(lead(orientation) OVER w, '') <> '' THEN lead(orientation) OVER w ELSE coalesce(lead(orientation, 2) OVER w, '') END AS ahead
  FROM ent WINDOW w AS (PARTITION BY report_id, field ORDER BY sentence_index, start, match_no)),
f(report_id, field, rn, filled, last) AS (
  SELECT report_id, field, rn, CASE WHEN orientation <> '' OR NOT paired THEN orientation ELSE ahead END, CASE WHEN orientation <> '' OR NOT paired THEN orientation ELSE ahead END FROM z WHERE rn = 1
  UNION ALL
  SELECT z.report_id, z.field, z.rn, CASE WHEN orientation <> '' OR NOT paired THEN orientation WHEN last <> '' THEN last ELSE ahead END,
    CASE WHEN CASE WHEN orientation <> '' OR NOT paired THEN orientation WHEN last <> '' THEN last ELSE ahead END <> '' THEN CASE WHEN orientation <> '' OR NOT paired THEN orientation WHEN last <> '' THEN last ELSE ahead END ELSE last END
  FROM f JOIN z ON z.report_id = f.report_id AND z.field = f.field AND z.rn = f.rn + 1)
SELECT report_id, field, sentence_index, start, keyword, orientation, filled FROM z JOIN f USING (report_id, field, rn)"""


@query(_FILL)
def laterality_fill(spark, sf_dir):
    return en.filled_laterality(ents(spark, sf_dir))


@query(o.with_(o.SYN, o.KG, o.sent()) + """, h AS (SELECT DISTINCT report_id, field, sentence_index, keyword, CAST(strpos(sentence, keyword) - 1 AS INTEGER) AS start, CAST(strpos(sentence, keyword) - 1 + length(keyword) AS INTEGER) AS stop FROM sent JOIN kg ON contains(sentence, keyword))
SELECT report_id, field, sentence_index, keyword, start FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.report_id = b.report_id AND a.field = b.field AND a.sentence_index = b.sentence_index AND b.start <= a.start AND b.stop >= a.stop AND (b.start < a.start OR b.stop > a.stop))""")
def keyword_containment(spark, sf_dir):
    """Every name in a sentence, overlapping ones too, without those inside a longer one."""
    hits = extra.name_places(en.sentences(synthetic_reports(spark, sf_dir)), spark)
    return extra.outermost(hits, ["report_id", "field", "sentence_index"]).select("report_id", "field", "sentence_index", "keyword", "start")


# --- relations between entities ------------------------------------------------------

@query(o.EXAMS + f"""
, e AS (SELECT report_id, path, orientation FROM ent WHERE field = 'description'),
x AS (SELECT * FROM exams WHERE NOT contains(StudyPart, '手术') AND report_id IN (SELECT report_id FROM e))
SELECT DISTINCT report_id, exam FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.report_id = x.report_id AND {o.related('exam_path', 'path')} AND NOT {o.opposite('exam_side', 'orientation')})""")
def part_missing(spark, sf_dir):
    r = synthetic_reports(spark, sf_dir)
    return checks.part_missing(r, en.entities(r))


@query(o.EXAMS + f"""
SELECT DISTINCT report_id, sentence FROM (SELECT x.report_id, e.sentence_index, e.sentence, e.start FROM exams x JOIN ent e ON x.report_id = e.report_id AND e.field = 'description' AND {o.related('exam_path', 'path')}
GROUP BY ALL HAVING bool_and({o.opposite('exam_side', 'orientation')}))""")
def part_inverse(spark, sf_dir):
    r = synthetic_reports(spark, sf_dir)
    return checks.part_inverse(r, en.entities(r))


@query(o.ENTITIES + f"""
, d AS (SELECT * FROM ent WHERE field = 'description' AND positive = 3), c AS (SELECT * FROM ent WHERE field = 'conclusion' AND positive >= 2),
hit AS (SELECT DISTINCT d.report_id, d.sentence_index FROM d JOIN c ON d.report_id = c.report_id AND (list_contains(string_split(d.path, '>'), c.position) OR list_contains(string_split(c.path, '>'), d.position)) AND NOT {o.opposite('d.orientation', 'c.orientation')})
SELECT DISTINCT d.report_id, d.sentence FROM d ANTI JOIN hit ON d.report_id = hit.report_id AND d.sentence_index = hit.sentence_index""")
def conclusion_missing(spark, sf_dir):
    return checks.missing_conclusions(synthetic_reports(spark, sf_dir))


def _parts(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[,，]'), lambda p: trim(p)), lambda p: p <> '')"


_GRAMS = lambda x: f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1) + 1), lambda i: substr({x}, i, 2)))"
_DICE = lambda a, b: f"(2.0 * len(list_intersect({_GRAMS(a)}, {_GRAMS(b)})) / (len({_GRAMS(a)}) + len({_GRAMS(b)})))"
_ILLNESS = f"coalesce(list_max(flatten(list_transform({_parts('d.illness')}, lambda x: list_transform({_parts('c.illness')}, lambda y: CASE WHEN contains(x, y) OR contains(y, x) THEN 0.5 ELSE {_DICE('x', 'y')} END)))), 0.0)"
_PAIRS = f"""
, pairs0 AS (
  SELECT d.report_id, d.sentence AS ds, c.sentence AS cs, d.orientation AS dor, c.orientation AS cor, CASE WHEN d.orientation <> c.orientation THEN 0.6 ELSE 0.7 END AS part,
         CAST({_ILLNESS} AS DOUBLE) - CASE WHEN (d.positive >= 2) <> (c.positive >= 2) THEN 0.2 ELSE 0.0 END AS ill
  FROM ent d JOIN ent c ON d.report_id = c.report_id AND d.field = 'description' AND c.field = 'conclusion' AND {o.related('d.path', 'c.path')} AND d.positive >= 2
), pairs AS (SELECT *, CASE WHEN round(ill, 9) < 0.1 THEN 0.0 ELSE round(0.3 * part + 0.7 * ill, 6) END AS score FROM pairs0)"""


@query(o.ENTITIES + _PAIRS + f"""
, p AS (SELECT * FROM pairs WHERE score >= 0.15), r AS (SELECT * FROM p WHERE NOT {o.opposite('dor', 'cor')}),
w AS (SELECT report_id, ds, cs, max(score) AS s FROM p WHERE {o.opposite('dor', 'cor')} GROUP BY ALL),
bd AS (SELECT report_id, ds, max(score) AS b FROM r GROUP BY ALL), bc AS (SELECT report_id, cs, max(score) AS b FROM r GROUP BY ALL),
k AS (SELECT w.*, CASE WHEN bd.b IS NULL THEN 1.0 ELSE round(s - bd.b, 6) END AS rp, CASE WHEN bc.b IS NULL THEN 1.0 ELSE round(s - bc.b, 6) END AS cp FROM w LEFT JOIN bd USING (report_id, ds) LEFT JOIN bc USING (report_id, cs)),
g AS (SELECT *, round(rp + cp, 6) AS total FROM k WHERE rp > 0 AND ((cp > 0.006 AND s >= 0.5) OR (cp = 1 AND s >= 0.4))),
f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY report_id, ds ORDER BY total DESC, cs) = 1)
SELECT report_id, ds AS description, cs AS conclusion FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY report_id, cs ORDER BY total DESC, ds) = 1)""")
def orient_error(spark, sf_dir):
    return checks.orient_errors(ents(spark, sf_dir))


@query(o.with_(o.SYN, o.KG, o.sent(("apply",), "sa"), o.ent("a", "sa"), o.sent(("description",), "sd"), o.ent("d", "sd")) + f"""
, p AS (SELECT d.report_id, d.sentence AS report_sentence, a.sentence AS apply_sentence, a.path AS a_path, {o.opposite('a.orientation', 'd.orientation')} AS far FROM a JOIN d ON a.report_id = d.report_id AND {o.related('a.path', 'd.path')})
SELECT DISTINCT report_id, report_sentence, apply_sentence FROM (SELECT *, bool_and(far) OVER (PARTITION BY report_id, apply_sentence, a_path) AS all_far FROM p) WHERE all_far""")
def apply_orient(spark, sf_dir):
    return checks.apply_orient(synthetic_reports(spark, sf_dir))


_KEYS = "[" + ", ".join(f"'{k}'" for k in L.key_part.split("|")) + "]"


@query(o.ENTITIES + f"""
, b AS (SELECT *, list_intersect(string_split(path, '>'), {_KEYS}) AS organs FROM ent WHERE NOT {o.has('sentence', L.contradiction_exclude)} AND NOT {o.has('sentence', '(?i)' + L.ignore_sentence)}),
n AS (SELECT *, unnest(range(1, len(attribute) + 1)) AS k FROM b WHERE len(organs) > 0 AND positive <= 1 AND measure = 0 AND length(regexp_replace(illness, '{L.filler}', '', 'g')) > 1),
p AS (SELECT n.report_id, n.k, n.sentence AS neg, n.field AS nf, n.sentence_index AS ni, n.start AS ns, n.match_no AS nm, q.sentence AS pos, (q.field, q.sentence_index, q.start, q.match_no) AS q_at, round({_DICE('n.sentence', 'q.sentence')}, 6) AS similarity
  FROM n JOIN (SELECT * FROM b WHERE len(organs) > 0 AND positive >= 2) q ON n.report_id = q.report_id AND list_contains(string_split(q.path, '>'), n.position) AND list_has_any(n.organs, q.organs) AND NOT {o.opposite('n.orientation', 'q.orientation')}
   AND CASE WHEN n.attribute[n.k] = 'other_description' THEN len({o.found('n.sentence', L.sub_part)}) = 0 OR len({o.found('q.sentence', L.sub_part)}) = 0 OR list_has_any({o.found('n.sentence', L.sub_part)}, {o.found('q.sentence', L.sub_part)}) ELSE list_contains(q.attribute, n.attribute[n.k]) END),
best AS (SELECT report_id, neg, nf, ni, ns, nm, k, arg_min(pos, (similarity, q_at, pos)) AS pos, min(similarity) AS s FROM p GROUP BY ALL)
SELECT DISTINCT report_id, neg, pos FROM (SELECT * FROM best WHERE s <= {L.alike} QUALIFY row_number() OVER (PARTITION BY report_id, neg, nf, ni, ns, nm ORDER BY k) = 1)""")
def contradiction(spark, sf_dir):
    return checks.contradictions(ents(spark, sf_dir))


@query(o.ENTITIES + f"""
, rules(rule, device, pattern, part, least, described, category) AS (VALUES {fx.sql_list(fx.CRITICAL)}),
hit AS (SELECT ent.report_id, rule, category, part, least, described, sentence, sentence_index, start FROM ent JOIN syn USING (report_id) JOIN rules ON regexp_matches(modality, device) AND regexp_matches(sentence, pattern) AND list_contains(string_split(path, '>'), part)
  WHERE field = 'conclusion' AND NOT {o.has('sentence', L.critical_ignore)}),
ok AS (SELECT DISTINCT hit.report_id, rule, category, hit.sentence, hit.sentence_index, hit.start FROM hit JOIN ent d ON hit.report_id = d.report_id
  WHERE CASE WHEN least > 0 THEN (CASE WHEN least < 1 THEN d.percent >= least ELSE d.measure >= least END) AND list_contains(string_split(d.path, '>'), part)
             WHEN described <> '' THEN d.field = 'description' AND regexp_matches(d.sentence, described) ELSE true END)
SELECT report_id, rule, category, sentence AS description FROM ok QUALIFY row_number() OVER (PARTITION BY report_id, rule ORDER BY sentence_index, start, sentence) = 1""")
def critical_value(spark, sf_dir):
    r = synthetic_reports(spark, sf_dir)
    return checks.critical_values(r, en.entities(r))


#: Three rules for each row of ``part``: wording from words of the lexicon by the key, one of two, one behind the other, or one of two before a third.
_W = [w for w in fx.WORDS if len(w) > 1]
_NODES = sorted({n for r in fx.KG for n in r[0].split(">")})
_PICK = lambda words, n: f"[{', '.join(o.quote(w) for w in words)}][{n} % {len(words)} + 1]"
_MADE = f"""made(rule, pattern, part) AS (SELECT CAST(p_partkey * 3 + k AS INTEGER), CASE k WHEN 0 THEN a || '|' || b WHEN 1 THEN a || '.*' || b ELSE '(' || a || '|' || b || ')[^，]*' || c END, node
  FROM (SELECT p_partkey, k, {_PICK(_W, 'p_partkey')} AS a, {_PICK(_W, '(p_partkey // 7)')} AS b, {_PICK(_W, '(p_partkey // 3)')} AS c, {_PICK(_NODES, 'p_partkey')} AS node FROM part CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)))"""


@query(o.ENTITIES + f"""
, {_MADE}, c AS MATERIALIZED (SELECT report_id, sentence, path FROM ent WHERE field = 'conclusion' AND NOT {o.has('sentence', L.critical_ignore)}),
fit AS MATERIALIZED (SELECT sentence, part, rule FROM (SELECT DISTINCT sentence FROM c) JOIN made ON regexp_matches(sentence, pattern)),
pa AS (SELECT DISTINCT report_id, sentence, unnest(string_split(path, '>')) AS part FROM c)
SELECT rule, part, count(DISTINCT report_id) AS n_reports, min(report_id) AS first_report FROM pa JOIN fit USING (sentence, part) GROUP BY 1, 2""")
def critical_rules(spark, sf_dir):
    """Reports by rule, for thousands of rules of a table."""
    key = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    base = table(spark, sf_dir, "part").select(key, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    part = lambda n: F.floor(key / n)
    base = base.select("p_partkey", "k", pick(_W, key).alias("a"), pick(_W, part(7)).alias("b"), pick(_W, part(3)).alias("c"), pick(_NODES, key).alias("part"))
    pattern = F.when(F.col("k") == 0, F.concat_ws("|", "a", "b")).when(F.col("k") == 1, F.concat_ws(".*", "a", "b")).otherwise(F.concat(F.lit("("), "a", F.lit("|"), "b", F.lit(")[^，]*"), "c"))
    rules = base.select((key * 3 + F.col("k")).cast("int").alias("rule"), F.lit(".").alias("device"), pattern.alias("pattern"), "part", F.lit(0.0).alias("least"), F.lit("").alias("described"), F.lit("").alias("category"))
    return checks.rule_counts(synthetic_reports(spark, sf_dir), stored(rules))


@query(o.ENTITIES + f"""
, n AS (SELECT report_id, field, count(*) FILTER (positive >= 2) AS n, count(*) AS all_n FROM ent GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY count(*) DESC, field) = 1)
SELECT syn.report_id, CASE WHEN n.n IS NULL THEN 0.0 ELSE round({o.complexity_weight('(' + o.modality('modality') + ')')} * (n.n + 1), 6) END AS complexity FROM syn LEFT JOIN n USING (report_id)""")
def complexity(spark, sf_dir):
    r = synthetic_reports(spark, sf_dir)
    return checks.complexity(r, en.entities(r))


@query(o.ENTITIES + """SELECT report_id, string_split(path, '>')[1] AS root, coalesce(array_to_string(list_sort(list(DISTINCT position) FILTER (positive >= 2)), '；'), '阴性') AS parts, bool_or(positive >= 2) AS any_positive FROM ent GROUP BY 1, 2""")
def positive_parts(spark, sf_dir):
    return checks.positive_parts(ents(spark, sf_dir))


@query(o.REPORTS + f"""
SELECT count(*) AS total, count(*) FILTER ({o.has('modality', L.check_modality)}) AS success, count(*) FILTER (NOT {o.has('modality', L.check_modality)}) AS failed,
       round(avg(length({_BOTH})), 6) AS mean_chars, min(length({_BOTH})) AS min_chars, max(length({_BOTH})) AS max_chars FROM syn""")
def batch_summary(spark, sf_dir):
    r = synthetic_reports(spark, sf_dir).select(F.col("modality").rlike(L.check_modality).alias("ok"), F.length(F.concat("ReportStr", "ConclusionStr")).cast("long").alias("n"))
    return r.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg("n"), 6).alias("mean_chars"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"))
