"""Queries of the smaller operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.config import LEXICON as L
from tessera.dictionaries import DEFAULT
from tessera.operators import corpus, detect, entities as en, extra, growth, history, knowledge
from tessera.plans import oracle as o
from tessera.plans.more import _PATIENT, _RETRIEVED, _VALID, _frequent, _patients, _validated
from tessera.plans.queries import ents, query, table
from tessera.scratch import stored
from tessera.sources.reports import synthetic_reports

_ROOTS = ", ".join(f"'{r}'" for r in extra.DEEPER)
_DEPTH = "CASE " + " ".join(f"WHEN modality = '{k}' THEN {v}" for k, v in extra.DEPTH.items()) + " ELSE 5 END"


@query(o.ENTITIES + f"SELECT report_id, field, sentence_index, keyword, n[least({_DEPTH} + CASE WHEN n[1] IN ({_ROOTS}) THEN 1 ELSE 0 END, len(n))] AS part FROM (SELECT ent.*, modality, string_split(path, '>') AS n FROM ent JOIN syn USING (report_id))")
def shortened_paths(spark, sf_dir):
    r = synthetic_reports(spark, sf_dir)
    e = en.entities(r).join(r.select("report_id", "modality"), "report_id")
    return e.select("report_id", "field", "sentence_index", "keyword", extra.shortened(F.col("path"), F.col("modality")).alias("part"))


@query(o.ENTITIES + """SELECT report_id, field, sentence AS primary_sentence, """ + ", ".join(f"string_split(path, '>')[{k + 1}] AS part_level{k}" for k in range(6)) + """, orientation, positive >= 2 AS positive, measure, percent AS value_percent, illness FROM ent""")
def structured_store(spark, sf_dir):
    return history.structured_store(synthetic_reports(spark, sf_dir))


_TERMS = extra.TERMS


@query(o.SENTENCES + f"SELECT DISTINCT sentence, (sentence IN ({', '.join(o.quote(t) for t in _TERMS)}) OR regexp_matches(sentence, '.+({'|'.join(_TERMS)})$') OR " + " OR ".join(f"(contains(sentence, '{t}') AND length(sentence) < {len(t) + 3})" for t in _TERMS) + ") AS known FROM sent")
def medical_terms(spark, sf_dir):
    return en.sentences(synthetic_reports(spark, sf_dir)).select("sentence", extra.is_term(F.col("sentence")).alias("known")).distinct()


@query(o.ENTITIES + "SELECT report_id, keyword, field, sentence_index FROM ent QUALIFY row_number() OVER (PARTITION BY report_id, keyword ORDER BY field, sentence_index, start, match_no) = 1")
def distinct_entities(spark, sf_dir):
    return extra.first_of(ents(spark, sf_dir), ["report_id", "keyword"]).select("report_id", "keyword", "field", "sentence_index")


@query(o.ENTITIES + "SELECT report_id, position, count(*) AS n, count(*) = 1 AS single FROM ent GROUP BY 1, 2")
def entity_counts(spark, sf_dir):
    return ents(spark, sf_dir).groupBy("report_id", "position").agg(F.count("*").alias("n")).withColumn("single", F.col("n") == 1)


@query(o.ENTITIES + 'SELECT report_id, field, sentence_index, keyword, coalesce(lag("end") OVER w, -1) AS previous_end, coalesce(lead(start) OVER w, -1) AS next_start FROM ent WINDOW w AS (PARTITION BY report_id, field, sentence_index ORDER BY start, match_no)')
def entity_neighbours(spark, sf_dir):
    return extra.neighbours(ents(spark, sf_dir)).select("report_id", "field", "sentence_index", "keyword", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("previous_end", "next_start")))


@query("WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ一-鿿]+')) AS word, unnest(range(len(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ一-鿿]+')))) AS pos FROM conversations) SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, word, lag(word) OVER v AS before, lead(word) OVER v AS after FROM w WINDOW v AS (PARTITION BY conv_id, turn ORDER BY pos)")
def token_neighbours(spark, sf_dir):
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(corpus.WORD), F.lit(0))).alias("pos", "word"))
    w = Window.partitionBy("conv_id", "turn").orderBy("pos")
    return t.select("*", F.lag("word").over(w).alias("before"), F.lead("word").over(w).alias("after"))


@query(o.with_(o.SYN, o.KG, o.sent()) + ", h AS (SELECT DISTINCT report_id, field, sentence_index, sentence, keyword, CAST(strpos(sentence, keyword) - 1 AS INTEGER) AS start FROM sent JOIN kg ON contains(sentence, keyword)) SELECT report_id, field, sentence_index, keyword, start FROM h QUALIFY length(keyword) = max(length(keyword)) OVER (PARTITION BY report_id, field, sentence_index, start)")
def longest_names(spark, sf_dir):
    return extra.longest_names(en.sentences(synthetic_reports(spark, sf_dir)), spark).select("report_id", "field", "sentence_index", "keyword", "start")


@query(o.ENTITIES + "SELECT report_id, field, sentence_index, keyword FROM ent QUALIFY hi - lo = max(hi - lo) OVER (PARTITION BY report_id, field, sentence_index)")
def longest_axis(spark, sf_dir):
    return extra.longest_axis(ents(spark, sf_dir)).select("report_id", "field", "sentence_index", "keyword")


_TEMPLATES = (("胸部模板", ""), ("妇科模板", "女"), ("前列腺模板", "男"), ("儿科模板", "童"))


@query(o.REPORTS + f", t(template, want_sex) AS (VALUES {fx.sql_list(_TEMPLATES)}), p AS (SELECT report_id, template, want_sex, Sex AS sex, want_sex = '' OR want_sex = Sex AS fits FROM syn JOIN t ON contains(StudyPart, substr(template, 1, 1)) OR want_sex <> '') SELECT report_id, template, sex, want_sex FROM p QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY report_id)")
def mode_filter(spark, sf_dir):
    t = F.broadcast(spark.createDataFrame(_TEMPLATES, "template string, want_sex string"))
    rows = synthetic_reports(spark, sf_dir).join(t, F.contains("StudyPart", F.substring("template", 1, 1)) | (F.col("want_sex") != ""))
    return extra.mode_filtered(rows.select("report_id", "template", F.col("Sex").alias("sex"), "want_sex"), "report_id")


@query(o.ENTITIES + _PATIENT + f""", a AS (SELECT DISTINCT patient, report_id, position, orientation FROM pe WHERE field = 'description'), b AS (SELECT DISTINCT patient, report_id AS other_id, path, orientation FROM pe WHERE field = 'description' AND positive >= 2)
SELECT DISTINCT a.patient, report_id, other_id, position FROM a JOIN b ON a.patient = b.patient AND report_id > other_id AND list_contains(string_split(path, '>'), position) AND NOT {o.opposite('a.orientation', 'b.orientation')}""")
def history_matches(spark, sf_dir):
    return extra.history_matches(_patients(spark, sf_dir))


@query("WITH v(candidate_id, is_valid, confidence, reason) AS (VALUES " + fx.sql_list(fx.VERDICTS) + """), f AS (SELECT candidate_id AS finding_id, 'finding ' || candidate_id AS finding, CASE WHEN is_valid IS NULL THEN 'needs_review' WHEN is_valid AND confidence >= 0.7 THEN 'keep' WHEN is_valid AND confidence >= 0.5 THEN 'weak' ELSE 'drop' END AS action FROM v)
SELECT finding_id, CASE action WHEN 'weak' THEN '[弱阳性]' WHEN 'needs_review' THEN '[待审核]' ELSE '' END || finding AS text FROM f WHERE action <> 'drop'""")
def verdict_filter(spark, sf_dir):
    v = history.verdicts(spark)
    return extra.judged(v.select(F.col("candidate_id").alias("finding_id"), F.concat(F.lit("finding "), F.col("candidate_id").cast("string")).alias("finding")), v)


_SOUND = fx.sql_list([(c, h) for c, hs in extra.HOMOPHONES.items() for h in hs])


@query(o.SENTENCES + f""", g AS (SELECT substr(sentence, i, 2) AS word FROM (SELECT sentence, unnest(range(1, length(sentence))) AS i FROM sent)), f AS (SELECT word, count(*) AS freq FROM g GROUP BY 1), h(ch, other) AS (VALUES {_SOUND}),
m AS (SELECT DISTINCT CASE i WHEN 1 THEN other || substr(word, 2, 1) ELSE substr(word, 1, 1) || other END AS wrong, word AS correct, freq AS c_freq FROM (SELECT word, freq, unnest([1, 2]) AS i FROM f WHERE freq >= 100) JOIN h ON substr(word, i, 1) = ch)
SELECT m.wrong, m.correct, m.c_freq FROM m ANTI JOIN (SELECT word FROM f WHERE freq >= 100) k ON m.wrong = k.word""")
def homophone_pairs(spark, sf_dir):
    s = en.sentences(synthetic_reports(spark, sf_dir))
    freq = corpus.char_ngrams(s, 2, 2).groupBy(F.col("gram").alias("word")).agg(F.count("*").alias("freq"))
    return extra.homophone_pairs(freq, spark)


@query(_VALID + "SELECT level, count(*) AS n FROM v GROUP BY 1")
def level_distribution(spark, sf_dir):
    return _validated(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query(_RETRIEVED + ", g AS (SELECT candidate, path FROM top), k AS (SELECT DISTINCT path, md5(path) AS node_id FROM kg) SELECT candidate, count(node_id) AS known_nodes FROM g LEFT JOIN k USING (path) GROUP BY 1")
def node_validation(spark, sf_dir):
    r = knowledge.retrieve(spark, _frequent(spark, sf_dir))
    return r.join(knowledge.graph_index(spark).select("node_id", F.col("level_path").alias("path")), "path", "left").groupBy("candidate").agg(F.count("node_id").alias("known_nodes"))


@query(_VALID + ", pa AS (SELECT CASE WHEN is_new THEN 'node' WHEN candidate IN (SELECT keyword FROM kg) THEN 'known' ELSE 'alias' END AS kind, level FROM v) SELECT kind, level, count(*) AS n, kind <> 'known' AND level <> 'C' AS published FROM pa GROUP BY 1, 2")
def graph_growth(spark, sf_dir):
    """The whole way from reports to patches, counted: candidates by what they would become, and their level."""
    have = en.graph(spark).select(F.col("keyword").alias("candidate")).distinct().withColumn("known", F.lit(True))
    v = _validated(spark, sf_dir).join(F.broadcast(have), "candidate", "left")
    kind = F.when(F.col("is_new"), "node").when(F.col("known"), "known").otherwise("alias")
    return v.groupBy(kind.alias("kind"), "level").agg(F.count("*").alias("n")).withColumn("published", (F.col("kind") != "known") & (F.col("level") != "C"))


@query(o.ENTITIES + f"SELECT report_id, field, sentence_index, keyword, regexp_matches(sentence, '(?i){L.ignore_sentence}') AS ignore FROM ent")
def ignored_entities(spark, sf_dir):
    return extra.ignored(ents(spark, sf_dir)).select("report_id", "field", "sentence_index", "keyword", "ignore")


@query(o.REPORTS + "SELECT report_id, md5(ReportStr || '|' || ConclusionStr) AS cache_key FROM syn")
def cache_keys(spark, sf_dir):
    return synthetic_reports(spark, sf_dir).select("report_id", F.md5(F.concat_ws("|", "ReportStr", "ConclusionStr")).alias("cache_key"))


@query(o.ENTITIES + "SELECT count(*) AS before, count(DISTINCT (report_id, field, sentence_index, keyword)) AS after FROM ent")
def merge_statistics(spark, sf_dir):
    e = ents(spark, sf_dir)
    return e.agg(F.count("*").alias("before"), F.count_distinct("report_id", "field", "sentence_index", "keyword").alias("after"))


_SPANS = o.with_(o.SYN, o.KG, o.sent(("description",))).replace("WITH ", "WITH RECURSIVE ", 1) + """
, h AS (SELECT DISTINCT report_id || ':' || sentence_index AS key, CAST(strpos(sentence, keyword) - 1 AS INTEGER) AS start, CAST(strpos(sentence, keyword) - 1 + length(keyword) AS INTEGER) AS "end", 3 - least(length(keyword), 2) AS priority FROM sent JOIN kg ON contains(sentence, keyword)),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, priority, "end") AS rn FROM h),
k(key, rn, kept, last_end, last_priority) AS (
  SELECT key, rn, [rn], "end", priority FROM m WHERE rn = 1
  UNION ALL
  SELECT m.key, m.rn, CASE WHEN m.start >= last_end THEN list_append(kept, m.rn) WHEN m.priority < last_priority THEN list_append(kept[1:len(kept) - 1], m.rn) ELSE kept END,
    CASE WHEN m.start >= last_end OR m.priority < last_priority THEN m."end" ELSE last_end END, CASE WHEN m.start >= last_end OR m.priority < last_priority THEN m.priority ELSE last_priority END
  FROM k JOIN m ON m.key = k.key AND m.rn = k.rn + 1),
l AS (SELECT key, unnest(kept) AS rn FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1))
SELECT key, start, "end", CAST(priority AS INTEGER) AS priority FROM m JOIN l USING (key, rn)"""


@query(_SPANS)
def highlight_spans(spark, sf_dir):
    """All names of a description, overlapping ones too; of overlapping ones the longer stays."""
    sent = en.sentences(synthetic_reports(spark, sf_dir), ("description",))
    marks = extra.name_places(sent, spark).select(F.concat_ws(":", "report_id", "sentence_index").alias("key"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("end"), (3 - F.least(F.length("keyword"), F.lit(2))).cast("int").alias("priority"))
    return extra.kept_highlights(marks, "key")


@query()
def structured_entities(spark, sf_dir):
    return detect.structured_entities(synthetic_reports(spark, sf_dir))


#: Names that the graph lacks at first.
_LATE = ("胆囊", "左肾", "肺上叶", "头颅")


@query(o.ENTITIES + 'SELECT report_id, field, sentence_index, match_no, keyword, start, "end", path, orientation, positive FROM ent')
def graph_refresh(spark, sf_dir):
    """Entities by a graph that lacks names, then brought up to date by a patch: those of the whole graph."""
    reports = synthetic_reports(spark, sf_dir)
    old = replace(DEFAULT, kg=tuple(r for r in DEFAULT.kg if r[0] not in _LATE))
    was = stored(en.entities(reports, dicts=old))
    out, _ = growth.refreshed(reports, was, old, DEFAULT)
    return out.select("report_id", "field", "sentence_index", "match_no", "keyword", "start", "end", "path", "orientation", "positive")
