"""Queries of the text operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.config import LEXICON as L
from tessera.operators import checks, corpus, quality, texts
from tessera.plans import grammar as pg
from tessera.plans import more as _more  # noqa: F401  its SQL is built upon
from tessera.plans import oracle as o
from tessera.plans.queries import SQL, ents, query, table
from tessera.sources.reports import synthetic_reports

_SEP = "chr(10) || chr(13)"


# --- paragraphs ---------------------------------------------------------------------------------


def _paragraphs(spark, sf_dir):
    k = F.pmod("report_id", F.lit(4))
    more = F.when(k == 0, "心功能分析 射血分数：45 左室 舒张末期直径 12 mm").when(k == 1, "肝脏大小：12.5 厚度 3 cm，血流 2 m/s").when(k == 2, " 心房大小 mm cm").otherwise("大小大小大小")
    return synthetic_reports(spark, sf_dir).select("report_id", F.concat("ReportStr", F.lit("\n\r"), more, F.lit("\n\r"), "ConclusionStr").alias("text"))


_PARA = o.with_(o.SYN, f"""pa AS (SELECT report_id, ReportStr || {_SEP} || CASE report_id % 4 WHEN 0 THEN '心功能分析 射血分数：45 左室 舒张末期直径 12 mm' WHEN 1 THEN '肝脏大小：12.5 厚度 3 cm，血流 2 m/s' WHEN 2 THEN ' 心房大小 mm cm' ELSE '大小大小大小' END || {_SEP} || ConclusionStr AS text FROM syn)""")


def _score(x: str) -> str:
    word = "0-9A-Za-z_一-鿿"
    head = " OR ".join(f"starts_with(trim({x}), '{h}')" for h in texts.HEADERS)
    terms = " + ".join(f"(length({x}) - length(replace({x}, '{t}', ''))) // {len(t)}" for t in texts.TERMS)
    unit = texts.UNIT.replace("0-9A-Za-z_\\u4e00-\\u9fff", word)
    return f"(10 * len(regexp_extract_all({x}, '[一-龥\\s]+：\\s*[0-9.]+')) + 20 * CAST(({head}) AS BIGINT) + {terms} + len(regexp_extract_all({x}, {o.quote(unit)})))"


@query(_PARA + f"SELECT report_id, n, CAST({_score('p')} AS BIGINT) AS score, {_score('p')} > 5 AS lists FROM (SELECT report_id, unnest(l) AS p, CAST(unnest(range(len(l))) AS INTEGER) AS n FROM (SELECT report_id, string_split(text, {_SEP}) AS l FROM pa))")
def measurement_paragraph(spark, sf_dir):
    p = _paragraphs(spark, sf_dir).select("report_id", F.posexplode(F.split("text", "\n\r")).alias("n", "p"))
    return p.select("report_id", "n", texts.measurement_score(F.col("p")).alias("score"), (texts.measurement_score(F.col("p")) > 5).alias("lists"))


@query(_PARA + f"SELECT report_id, array_to_string(list_filter(string_split(text, {_SEP}), lambda p: {_score('p')} <= 5), {_SEP}) AS text FROM pa")
def plain_paragraphs(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("report_id", texts.plain_paragraphs(F.col("text")).alias("text"))


# --- splitting, words, cleaning -----------------------------------------------------------------

_SPLIT = lambda s: f"len(list_filter(list_transform(string_split_regex(text, {o.quote(texts.SPLITTERS[s])}), lambda p: trim(p)), lambda p: length(p) >= {5 if s == 'mining' else 1}))"


@query("SELECT conv_id, turn, " + ", ".join(f"CAST({_SPLIT(s)} AS BIGINT) AS n_{s}" for s in texts.SPLITTERS) + " FROM conversations")
def sentence_splitters(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *(F.size(texts.parts(F.col("text"), s)).cast("long").alias(f"n_{s}") for s in texts.SPLITTERS))


@query(SQL["report_word_freq"].replace("SELECT word, freq FROM fr", "SELECT word, freq FROM fr WHERE length(word) BETWEEN 2 AND 6 AND NOT regexp_matches(word, '^[0-9]+$') AND NOT regexp_matches(word, '^[A-Za-z]+$') AND NOT regexp_matches(word, '[，。、；：？！（）【】《》]')"))
def valid_words(spark, sf_dir):
    from tessera.operators import grammar

    return grammar.token_freq(pg.clean_tokens(spark, sf_dir)).where(texts.valid_word(F.col("word")))


@query(r"""
SELECT conv_id, turn, translate(trim(regexp_replace(text, '[ \x{00a0}\x{007f}\x{3000}]+', ' ', 'g')), '，。；：！？（）【】《》', ',.;:!?()[]<>') AS clean,
       len(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')) AS n_numbers, regexp_matches(text, '[0-9A-Za-z]') AS latin,
       contains(lower(text), 'the') OR contains(lower(text), 'que') AS known
FROM conversations""")
def text_cleaning(spark, sf_dir):
    from tessera.functions import text as ft

    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ft.plain_punctuation(ft.clean_space(t)).alias("clean"), F.size(ft.numbers(t)).cast("long").alias("n_numbers"), ft.has_digit_or_latin(t).alias("latin"), ft.contains_any(t, ["the", "que"]).alias("known"))


def _dirty(spark, sf_dir):
    k = F.pmod("report_id", F.lit(5))
    t = F.col("ReportStr")
    dirty = F.when(k == 0, F.concat(F.lit("1. "), t)).when(k == 1, F.replace(t, F.lit("，"), F.lit(" ，  "))).when(k == 2, F.concat(t, F.lit("T12椎体及L5椎体骨折a.b。"))).when(k == 3, F.concat(t, F.lit("，，上肺、、 心影"))).otherwise(F.concat(t, F.lit("C型臂下L型")))
    return synthetic_reports(spark, sf_dir).select("report_id", dirty.alias("text"))


_RULES = ((1, "上肺", "肺上叶", False), (2, "下肺", "肺下叶", False), (3, "约(\\d)", "$1", True), (4, "心影", "心脏", False), (5, "片状高密度影", "高密度片影", False))
_NORM = o.with_(o.SYN, "di AS (SELECT report_id, CASE report_id % 5 WHEN 0 THEN '1. ' || ReportStr WHEN 1 THEN replace(ReportStr, '，', ' ，  ') WHEN 2 THEN ReportStr || 'T12椎体及L5椎体骨折a.b。' WHEN 3 THEN ReportStr || '，，上肺、、 心影' ELSE ReportStr || 'C型臂下L型' END AS text FROM syn)") + r"""
, a AS (SELECT report_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \x{00a0}\x{007f}\x{3000}]+', ' ', 'g')), ' ?([，。；：、,;:]) ?', '\1', 'g'), '(?m)^[\n\t\r]*[0-9]+[.、]\s*', '', 'g') AS t FROM di),
b AS (SELECT report_id, replace(replace(replace(t, '上肺', '肺上叶'), '下肺', '肺下叶'), '心影', '心脏') AS t FROM a),
c AS (SELECT report_id, CASE WHEN regexp_matches(t, '椎|横突|棘|脊|黄韧带|肋|颈|骶|尾骨|隐裂|腰化|骶化|胸化|项韧带|纵韧带') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(^|[^A-Za-z0-9])C([0-9])', '\1颈\2', 'g'), '(^|[^A-Za-z0-9])T([0-9])', '\1胸\2', 'g'), '(^|[^A-Za-z0-9])L([0-9])', '\1腰\2', 'g'), '(^|[^A-Za-z0-9])S([0-9])', '\1骶\2', 'g') ELSE t END AS t FROM b),
d AS (SELECT report_id, regexp_replace(trim(regexp_replace(replace(t, '片状高密度影', '高密度片影'), '约([0-9])', '\1', 'g')), '\s+', ' ', 'g') AS t FROM c)
SELECT report_id, regexp_replace(regexp_replace(t, '[,，、]{2,}', '、', 'g'), '([A-Za-z])[.]([A-Za-z])', '\1。\2', 'g') AS clean FROM d"""


@query(_NORM)
def normalised_text(spark, sf_dir):
    return _dirty(spark, sf_dir).select("report_id", texts.normalised(F.col("text"), _RULES).alias("clean"))


@query()
def spine_rib_expand(spark, sf_dir):
    """The reports' own text and a phrase of numbered parts, written out where a range or a list calls for it."""
    k = F.pmod("report_id", F.lit(6))
    more = F.when(k == 0, "L3-5椎体骨质增生。").when(k == 1, "C5/6椎间盘突出。").when(k == 2, "T3、4、5骨折。").when(k == 3, "第1-3肋骨折。").when(k == 4, "L5/S1椎间盘膨出。").otherwise("未见骨折。")
    return synthetic_reports(spark, sf_dir).select("report_id", texts.normalised(F.concat("ReportStr", more), ()).alias("text"))


# --- numbered parts -------------------------------------------------------------------------------


def _numbered(spark, sf_dir):
    k, n = F.pmod("report_id", F.lit(7)), (1 + F.col("report_id") % 15).cast("string")
    more = F.when(k == 0, F.concat(F.lit("第"), n, F.lit("肋骨折"))).when(k == 1, F.concat(F.lit("L"), n, F.lit("椎体"))).when(k == 2, "第十一胸椎压缩").when(k == 3, F.concat(F.lit("第六指骨"), n)).when(k == 4, F.concat(F.lit("胸"), n, F.lit("椎体"))).when(k == 5, "二十后肋").otherwise(F.concat(F.lit("颈椎"), n))
    return synthetic_reports(spark, sf_dir).select("report_id", F.concat("ReportStr", more).alias("text"))


def _number(x: str) -> str:
    one = lambda c: f"(strpos('零一二三四五六七八九十', {c}) - 1)"
    return f"CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN CAST({x} AS BIGINT) WHEN length({x}) = 1 THEN {one(x)} WHEN ends_with({x}, '十') THEN 10 + greatest(0, {one(f'substr({x}, 2, 1)')}) ELSE -1 END"


_HITS = " UNION ALL ".join(f"SELECT report_id, '{p}' AS part, {m} AS most, unnest(regexp_extract_all(text, {o.quote('(?i)' + x)})) AS term, unnest(regexp_extract_all(text, {o.quote('(?i)' + x)}, 1)) AS n FROM nu" for p, m, xs in texts.NUMBERED for x in xs)


@query(o.with_(o.SYN, "nu AS (SELECT report_id, ReportStr || CASE report_id % 7 WHEN 0 THEN '第' || (1 + report_id % 15) || '肋骨折' WHEN 1 THEN 'L' || (1 + report_id % 15) || '椎体' WHEN 2 THEN '第十一胸椎压缩' WHEN 3 THEN '第六指骨' || (1 + report_id % 15) WHEN 4 THEN '胸' || (1 + report_id % 15) || '椎体' WHEN 5 THEN '二十后肋' ELSE '颈椎' || (1 + report_id % 15) END AS text FROM syn)") + f", h AS ({_HITS}) SELECT DISTINCT report_id, part, term FROM h WHERE {_number('n')} = -1 OR {_number('n')} > most")
def abnormal_terms(spark, sf_dir):
    return texts.impossible_numbers(_numbered(spark, sf_dir), "text").select("report_id", "part", "term")


# --- samples, ages, answers -----------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) % 100 < 10")
def hash_sample(spark, sf_dir):
    return texts.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10)


@query(o.REPORTS + "SELECT report_id, modality FROM syn WHERE modality = 'CT' ORDER BY report_id LIMIT 20")
def sample_reports(spark, sf_dir):
    return texts.tagged(synthetic_reports(spark, sf_dir), "modality", "CT", "report_id", 20).select("report_id", "modality")


_AGE = "CASE o_custkey % 5 WHEN 0 THEN (o_custkey % 90) || 'Y' WHEN 1 THEN (o_custkey % 12) || 'M' WHEN 2 THEN (o_custkey % 28) || 'D' WHEN 3 THEN '0' || (o_custkey % 10) || 'y' ELSE '不详' END"
_AGE_TEMPLATES = (("胸部成人", "胸", ""), ("胸部儿童", "胸", "child"), ("胸部婴儿", "胸", "infant"), ("胸部新生儿", "胸", "newborn"), ("胸部老年", "胸", "elderly"))


@query(f"WITH a AS (SELECT o_orderkey AS report_id, {_AGE} AS age FROM orders), g AS (SELECT report_id, age, TRY_CAST(regexp_extract(age, '([0-9]+)', 1) AS INTEGER) AS n FROM a), w AS (SELECT report_id, CASE WHEN n IS NULL THEN NULL WHEN contains(upper(age), 'D') THEN 'newborn' WHEN contains(upper(age), 'M') THEN 'infant' WHEN n <= 6 THEN 'child' WHEN n >= 60 THEN 'elderly' ELSE 'adult' END AS grp FROM g), t(template, part, want) AS (VALUES {fx.sql_list(_AGE_TEMPLATES)}), p AS (SELECT report_id, coalesce(grp, '') AS age_group, template, coalesce(want = grp, false) AS fits FROM w, t) SELECT report_id, age_group, template FROM p QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY report_id)")
def age_templates(spark, sf_dir):
    """Templates that suit a patient's age, or all where none does."""
    from pyspark.sql import Window

    c = F.col("o_custkey")
    k = c % 5
    age = F.when(k == 0, F.concat((c % 90).cast("string"), F.lit("Y"))).when(k == 1, F.concat((c % 12).cast("string"), F.lit("M"))).when(k == 2, F.concat((c % 28).cast("string"), F.lit("D"))).when(k == 3, F.concat(F.lit("0"), (c % 10).cast("string"), F.lit("y"))).otherwise("不详")
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), texts.age_group(age).alias("grp"))
    t = F.array(*(F.struct(F.lit(n).alias("template"), F.lit(w).alias("want")) for n, _, w in _AGE_TEMPLATES))
    p = a.select("report_id", F.coalesce("grp", F.lit("")).alias("age_group"), F.explode(t).alias("t"))
    p = p.select("report_id", "age_group", "t.template", (F.col("t.want") == F.col("age_group")).alias("fits"))
    p = p.withColumn("fits", F.col("fits") & (F.col("age_group") != ""))
    return p.withColumn("any_fit", F.bool_or("fits").over(Window.partitionBy("report_id"))).where("fits OR NOT any_fit").select("report_id", "age_group", "template")


@query("""SELECT order_id, coalesce(json_extract_string(j, '$.is_valid'), 'unknown') AS is_valid, coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), -1.0) AS confidence
FROM (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '{"is_valid": ' || CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "confidence": 0.' || (o_custkey % 10) || '}' END AS j FROM orders)""")
def json_answers(spark, sf_dir):
    """Whole answers, answers in another dialect, and cut ones; what can't be read is unknown."""
    even, digit = F.col("o_custkey") % 2 == 0, (F.col("o_custkey") % 10).cast("string")
    good = F.concat(F.lit('Answer: {"is_valid": '), F.when(even, "true").otherwise("false"), F.lit(', "confidence": 0.'), digit, F.lit("} thanks"))
    loose = F.concat(F.lit("{'is_valid': "), F.when(even, "True").otherwise("False"), F.lit(", 'confidence': 0."), digit, F.lit(", }"))
    cut = F.concat(F.lit('```json {"is_valid": '), F.when(even, "true").otherwise("false"), F.lit(', "confidence": 0.'), digit)
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "no answer").when(k == 1, good).when(k == 2, loose).otherwise(cut)
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.from_json(texts.repaired(text), "is_valid boolean, confidence double").alias("a"))
    return a.select("order_id", F.coalesce(F.col("a.is_valid").cast("string"), F.lit("unknown")).alias("is_valid"), F.coalesce("a.confidence", F.lit(-1.0)).alias("confidence"))


# --- annotation, rates, settings ------------------------------------------------------------------

_ANNO = o.ENTITIES + """
, ba AS (SELECT report_id, field, sentence_index, keyword, start, "end", illness, "end" AS fs, "end" + length(illness) AS fe FROM ent WHERE illness <> '' AND start >= 0 AND start < "end" AND "end" + length(illness) <= length(sentence)),
sp AS (SELECT *, CAST(row_number() OVER (PARTITION BY report_id, field, sentence_index ORDER BY label, start_offset, end_offset, keyword) - 1 AS INTEGER) AS id FROM (
  SELECT DISTINCT report_id, field, sentence_index, 'ANAT' AS label, start AS start_offset, "end" AS end_offset, keyword FROM ba UNION ALL SELECT DISTINCT report_id, field, sentence_index, 'FIND', fs, fe, illness FROM ba))
"""


@query(_ANNO + "SELECT report_id, field, sentence_index, id, label, CAST(start_offset AS INTEGER) AS start_offset, CAST(end_offset AS INTEGER) AS end_offset, keyword FROM sp")
def doccano_export(spark, sf_dir):
    return texts.annotations(ents(spark, sf_dir))[0]


@query(_ANNO + "SELECT DISTINCT report_id, field, sentence_index, a.id AS from_id, f.id AS to_id FROM ba JOIN sp a USING (report_id, field, sentence_index) JOIN sp f USING (report_id, field, sentence_index) WHERE a.label = 'ANAT' AND a.start_offset = start AND a.end_offset = \"end\" AND a.keyword = ba.keyword AND f.label = 'FIND' AND f.start_offset = fs AND f.end_offset = fe AND f.keyword = illness")
def doccano_relations(spark, sf_dir):
    return texts.annotations(ents(spark, sf_dir))[1]


@query(SQL["grammar_errors"][: SQL["grammar_errors"].rindex("SELECT report_id")] + """, tr AS (SELECT report_id, ReportStr || ConclusionStr AS t FROM syn), n AS (SELECT count(*) AS n FROM syn)
SELECT rule_source, round(count(DISTINCT report_id) / CAST(any_value(n) AS DOUBLE), 6) AS trigger_rate, round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS mean_hits, round(avg(CAST(suggestion IS NOT NULL AND contains(t, suggestion) AND NOT contains(t, error) AS DOUBLE)), 6) AS precision FROM de JOIN tr USING (report_id), n GROUP BY 1""")
def grammar_rates(spark, sf_dir):
    """How often each source of errors speaks, and how often the untouched report has its suggestion and not the error."""
    clean = synthetic_reports(spark, sf_dir).select("report_id", F.concat("ReportStr", "ConclusionStr").alias("t"))
    total = clean.count()
    e = pg.Lexicons(spark, sf_dir).detected().join(clean, "report_id")
    right = F.col("suggestion").isNotNull() & F.coalesce(F.contains("t", F.col("suggestion")), F.lit(False)) & ~F.contains("t", F.col("error"))
    return e.groupBy("rule_source").agg(F.round(F.count_distinct("report_id") / total, 6).alias("trigger_rate"), F.round(F.count("*") / total, 6).alias("mean_hits"), F.round(F.avg(right.cast("double")), 6).alias("precision"))


@query(SQL["parameter_grid"] + " ORDER BY n_pairs DESC, n_wrong, least_right DESC, most_wrong LIMIT 1")
def best_setting(spark, sf_dir):
    """The setting with the most pairs; of equal ones the one with fewer wrong words, then the stricter."""
    freq = corpus.word_freq(table(spark, sf_dir, "documents"))
    grid = corpus.parameter_grid(spark, corpus.confusion_pairs(freq), [20, 50], [1, 2])
    return grid.orderBy(F.desc("n_pairs"), "n_wrong", F.desc("least_right"), "most_wrong").limit(1)


# --- the older engine's answers ----------------------------------------------------------------------


@query(o.SENTENCES + r""", r AS (SELECT report_id, field, sentence_index, sentence, unnest(list_concat([''], regexp_extract_all(replace(sentence, '*', '×'), '(?i)(?:[0-9]+(?:[.][0-9]+)?×)*[0-9]+(?:[.][0-9]+)?(?:mm|cm|毫米|厘米|米|m)'))) AS run FROM sent),
u AS (SELECT *, lower(regexp_extract(run, '(?i)(mm|cm|毫米|厘米|米|m)$', 1)) AS unit, list_max(list_transform(regexp_extract_all(run, '[0-9]+(?:[.][0-9]+)?'), lambda n: CAST(n AS DOUBLE))) AS n FROM r)
SELECT report_id, field, sentence_index, coalesce(max(CASE WHEN run <> '' THEN n * CASE WHEN unit IN ('cm', '厘米') THEN 10.0 WHEN unit IN ('mm', '毫米') THEN 1.0 ELSE 100.0 END END), 0.0) AS measure FROM u GROUP BY 1, 2, 3""")
def legacy_measures(spark, sf_dir):
    from tessera.operators.entities import sentences

    return sentences(synthetic_reports(spark, sf_dir)).select("report_id", "field", "sentence_index", texts.inherited_measure(F.col("sentence")).alias("measure"))


def _words(name: str, none: str, head: str) -> str:
    many = f"array_to_string(list_transform(range(1, len({name}) + 1), lambda i: i || '.' || {name}[i]), '；')"
    return f"CASE WHEN {name} IS NULL OR len({name}) = 0 THEN '{none}' WHEN len({name}) = 1 THEN '{head}' || {name}[1] ELSE '{head}' || {many} END AS {name}"


_SAYS = (("conclusion_missing", "未检查到描述与结论不符", "结论可能遗漏: "), ("measure_unit_error", "未检测到测量值错误", "测量值可能错误: "), ("none_standard_term", "未检测到常见术语错误", "术语不标准: "))
_LISTS = f"""m AS (SELECT report_id, list_sort(list(DISTINCT sentence)) AS conclusion_missing FROM ({SQL['conclusion_missing']}) GROUP BY 1), u AS (SELECT report_id, list_sort(list(DISTINCT measure_text)) AS measure_unit_error FROM ({SQL['measure_limit']}) GROUP BY 1),
t AS (SELECT report_id, list_sort(list(DISTINCT term)) AS none_standard_term FROM ({SQL['nonstandard_terms']}) GROUP BY 1)"""


@query(o.with_(o.SYN, _LISTS) + f"SELECT syn.report_id, {', '.join(_words(*s) for s in _SAYS)} FROM syn LEFT JOIN m USING (report_id) LEFT JOIN u USING (report_id) LEFT JOIN t USING (report_id)")
def legacy_report(spark, sf_dir):
    """Three findings as the older engine words them, a report without one included."""
    found = quality.older_report(synthetic_reports(spark, sf_dir))
    return found.select("report_id", *(texts.in_words(F.col(n), none, head).alias(n) for n, none, head in _SAYS))


_PUT = "replace(replace(StudyPart, '上腹部', '腹部'), '平扫+DWI', '弥散平扫')"


@query(SQL["special_missing"].replace(o.SYN, f"syn AS (SELECT * REPLACE ({_PUT} AS StudyPart) FROM ({o.REPORTS_SQL}))"))
def legacy_special_missing(spark, sf_dir):
    """Special techniques by orders whose wording is put right first."""
    part = F.replace(F.replace(F.col("StudyPart"), F.lit("上腹部"), F.lit("腹部")), F.lit("平扫+DWI"), F.lit("弥散平扫"))
    return checks.special_missing(synthetic_reports(spark, sf_dir).withColumn("StudyPart", part))


@query(o.REPORTS + f"SELECT report_id, len({o.found('ReportStr', L.female + '|' + L.male)}) AS n_words, regexp_matches(ReportStr, '{L.deny}') AS denies FROM syn")
def denied_reports(spark, sf_dir):
    """Words of either sex in a description, and whether it denies anything."""
    from tessera.functions.text import all_of

    return synthetic_reports(spark, sf_dir).select("report_id", F.size(all_of(F.col("ReportStr"), f"{L.female}|{L.male}")).cast("long").alias("n_words"), F.col("ReportStr").rlike(L.deny).alias("denies"))
