"""Further registered queries: the anatomy graph, corpus lexicons, detection, search, audit, history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.dictionaries import Dictionaries
from tessera.functions import scan
from tessera.operators import axis, corpus, detect, entities as en, history, knowledge, summaries, vocabulary
from tessera.plans import oracle as o
from tessera.plans.queries import ents, query, table
from tessera.scratch import stored
from tessera.sources import sinks
from tessera.sources.reports import synthetic_reports

KG = o.with_(o.KG)

# --- the graph ------------------------------------------------------------------------


@query(KG + """SELECT level, node, min(lo) AS lo, max(hi) AS hi FROM (SELECT CAST(unnest(range(len(n))) AS INTEGER) AS level, unnest(n) AS node, lo, hi FROM (SELECT string_split(path, '>') AS n, lo, hi FROM kg)) GROUP BY 1, 2""")
def kg_parent_axis(spark, sf_dir):
    return knowledge.parent_axis(spark)


@query(KG + "SELECT keyword, array_to_string(list_sort(list(DISTINCT path)), '；') AS paths, count(DISTINCT path) AS n_paths FROM kg GROUP BY 1")
def kg_alias_map(spark, sf_dir):
    return knowledge.alias_map(spark)


@query(KG + "SELECT DISTINCT array_to_string(list_slice(n, 1, k), '>') AS path FROM (SELECT string_split(path, '>') AS n, unnest(range(1, len(string_split(path, '>')) + 1)) AS k FROM kg)")
def kg_paths(spark, sf_dir):
    return knowledge.root_paths(spark)


@query(KG + "SELECT md5(path) AS node_id, position AS canonical, path AS level_path, depth, count(*) - 1 AS n_aliases FROM kg GROUP BY path, position, depth")
def graph_index(spark, sf_dir):
    return knowledge.graph_index(spark)


@query(KG + """, p AS (SELECT DISTINCT array_to_string(list_slice(n, 1, k), '>') AS path, n[1] AS root, repeat('  ', CAST(k - 1 AS BIGINT)) || '- ' || n[k] AS line FROM (SELECT string_split(path, '>') AS n, unnest(range(1, len(string_split(path, '>')) + 1)) AS k FROM kg))
SELECT root, string_agg(line, chr(10) ORDER BY path) AS tree FROM p GROUP BY root""")
def kg_tree_text(spark, sf_dir):
    return knowledge.tree_text(spark)


@query(KG + """, g AS (SELECT path, lo, hi, string_split(path, '>')[1] AS root FROM kg WHERE keyword = position)
SELECT a.path AS a, b.path AS b FROM g a JOIN g b ON a.root = b.root AND a.path < b.path AND a.lo < b.hi AND b.lo < a.hi AND abs(a.lo - b.lo) <= 100""")
def axis_overlap(spark, sf_dir):
    return knowledge.axis_overlaps(spark)


_HAS = lambda x, p: f"regexp_matches({x}, {o.quote(p)})"
_CTX = " UNION ALL ".join(f"SELECT report_id, field, sentence_index, sentence, unnest(regexp_extract_all(sentence, {o.quote(p.replace(chr(92) + 'u4e00', '一').replace(chr(92) + 'u9fa5', '龥'))}, 1)) AS candidate, '{m}' AS method FROM s5" for p, m in zip(knowledge.CONTEXTS, knowledge.METHODS, strict=True))
_MENTION = f"""
, s5 AS (SELECT * FROM sent WHERE length(trim(sentence)) >= 5),
gm AS (SELECT report_id, field, sentence_index, sentence, substr(sentence, i, n) AS candidate FROM (SELECT *, unnest(range(1, length(sentence) - n + 2)) AS i FROM (SELECT *, unnest(range(2, 9)) AS n FROM s5) WHERE length(sentence) >= n)),
mn AS MATERIALIZED (SELECT *, 'ngram' AS method FROM gm WHERE {_HAS('candidate', '[一-鿿]')} AND NOT {_HAS('candidate', '^[A-Za-z一-鿿]{1,2}$')} AND candidate NOT IN ({', '.join(map(o.quote, knowledge.STOP_WORDS))})
   AND NOT {_HAS('candidate', knowledge.MARKS)} AND {_HAS('candidate', knowledge.ANATOMY)} UNION ALL {_CTX})
"""
_DISCOVER = o.with_(o.SYN, o.KG, o.sent()) + _MENTION + """, di AS MATERIALIZED (SELECT candidate, count(*) AS frequency, min((report_id, field, sentence_index, sentence, method)) AS f FROM mn GROUP BY 1 HAVING count(*) >= 3),
disc AS MATERIALIZED (SELECT candidate, frequency, f[1] AS report_id FROM (SELECT candidate, frequency, [CAST(struct_extract(f, 1) AS BIGINT)] AS f FROM di) d WHERE NOT EXISTS (SELECT 1 FROM kg WHERE contains(candidate, keyword) OR contains(keyword, candidate)))
"""


def _sentences(spark, sf_dir):
    return en.sentences(synthetic_reports(spark, sf_dir))


@query(_DISCOVER + "SELECT candidate, frequency, struct_extract(f, 5) AS method, struct_extract(f, 1) AS report_id, struct_extract(f, 4) AS sentence FROM di WHERE candidate IN (SELECT candidate FROM disc)")
def discover_candidates(spark, sf_dir):
    return knowledge.discover(_sentences(spark, sf_dir), spark)


@query(_DISCOVER + "SELECT candidate, method, count(*) AS frequency FROM mn WHERE method <> 'ngram' GROUP BY 1, 2")
def context_candidates(spark, sf_dir):
    return knowledge.context_candidates(_sentences(spark, sf_dir))


#: What is looked up in the graph: frequent mentions, known or not.
_RETRIEVED = _DISCOVER + """
, best AS (SELECT candidate, path, CAST(max(CASE WHEN keyword = position AND candidate = keyword THEN 1.0 WHEN candidate = keyword THEN 0.95 WHEN keyword = position THEN 0.8 ELSE 0.7 END) AS DOUBLE) AS score
  FROM di JOIN kg ON contains(candidate, keyword) OR contains(keyword, candidate) GROUP BY 1, 2),
top AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY candidate ORDER BY score DESC, path) AS INTEGER) AS rank FROM best QUALIFY rank <= 5)
"""
_VALID = _RETRIEVED + """, nz AS (SELECT di.candidate, frequency, struct_extract(f, 1) AS report_id, arg_max(path, (score, path)) AS best_path, count(path) AS n_nodes,
  coalesce(max(score), round(least(0.9, 0.6 + 0.1 * log10(frequency)), 6)) AS confidence FROM di LEFT JOIN top ON di.candidate = top.candidate GROUP BY di.candidate, frequency, f),
v AS MATERIALIZED (SELECT nz.*, n_nodes > 0 AS is_alias, n_nodes = 0 AS is_new, CASE WHEN confidence >= 0.7 AND (n_nodes = 0 OR len(list_filter(string_split(best_path, '>'), lambda x: contains(StudyPart, x))) > 0) THEN 'A' WHEN confidence >= 0.7 THEN 'B' ELSE 'C' END AS level
  FROM nz JOIN syn USING (report_id))
"""


def _frequent(spark, sf_dir):
    return stored(knowledge.frequent(_sentences(spark, sf_dir)).select("candidate", "frequency", "first.report_id"))


def _validated(spark, sf_dir):
    c = _frequent(spark, sf_dir)
    return knowledge.validate(knowledge.normalised(c, knowledge.retrieve(spark, c)), synthetic_reports(spark, sf_dir), spark)


@query(_RETRIEVED + "SELECT candidate, path, score, rank FROM top")
def node_retrieval(spark, sf_dir):
    return knowledge.retrieve(spark, _frequent(spark, sf_dir))


@query(_VALID + "SELECT candidate, level, best_path, n_nodes, round(confidence, 6) AS confidence FROM v")
def validate_levels(spark, sf_dir):
    return _validated(spark, sf_dir).select("candidate", "level", "best_path", "n_nodes", F.round("confidence", 6).alias("confidence"))


@query(_VALID + "SELECT candidate, best_path, level FROM v WHERE is_alias AND level IN ('A', 'B') AND candidate NOT IN (SELECT keyword FROM kg)")
def alias_patch(spark, sf_dir):
    return knowledge.alias_patch(_validated(spark, sf_dir), spark)


@query(_VALID + "SELECT candidate, frequency, level FROM v WHERE is_new AND level IN ('A', 'B')")
def node_patch(spark, sf_dir):
    return knowledge.node_patch(_validated(spark, sf_dir))


# --- corpus lexicons --------------------------------------------------------------------

_WORDS = "w AS MATERIALIZED (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ一-鿿]+') AS l FROM documents))"
_FREQ = "f AS (SELECT word, count(*) AS freq FROM w GROUP BY 1)"
_BLANK = "bl AS MATERIALIZED (SELECT word, freq, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS blank FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM f WHERE length(word) >= 4 AND (freq <= 2 OR freq >= 20)))"
_PAIRS = "cp AS (SELECT a.word AS wrong, b.word AS correct, a.freq AS w_freq, b.freq AS c_freq FROM (SELECT * FROM bl WHERE freq <= 2) a JOIN (SELECT * FROM bl WHERE freq >= 20) b ON a.blank = b.blank AND a.word <> b.word)"
_NEXT = "nx AS MATERIALIZED (SELECT doc_id, pos, word AS a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w)"
_PHRASE = _NEXT + ", ph AS MATERIALIZED (SELECT a, b, count(*) AS n FROM nx WHERE b IS NOT NULL GROUP BY 1, 2)"
_ORDER = "ot AS (SELECT p.a || ' ' || p.b AS correct, p.b || ' ' || p.a AS error, p.n AS correct_freq, q.n AS error_freq, round(p.n / CAST(q.n + 1 AS DOUBLE), 6) AS ratio FROM ph p JOIN ph q ON p.a = q.b AND p.b = q.a AND p.a <> p.b WHERE round(p.n / CAST(q.n + 1 AS DOUBLE), 6) >= 2)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _freq(spark, sf_dir):
    return corpus.word_freq(_docs(spark, sf_dir))


@query(o.with_(_WORDS, _FREQ) + "SELECT word, freq FROM f")
def word_freq(spark, sf_dir):
    return _freq(spark, sf_dir)


@query(o.with_(_WORDS, _FREQ) + "SELECT CAST(sum(freq) AS BIGINT) AS total_words, count(*) AS unique_words FROM f")
def corpus_totals(spark, sf_dir):
    return corpus.corpus_totals(_freq(spark, sf_dir))


_TERMS = ("the", "ation", "que", "sch", "en")


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, CAST(sum((length(text) - length(replace(text, '{t}', ''))) // {len(t)}) AS BIGINT) AS n FROM documents" for t in _TERMS))
def substring_freq(spark, sf_dir):
    return corpus.substring_freq(_docs(spark, sf_dir), list(_TERMS))


_LONG = "length(word) BETWEEN 4 AND 12"
_VOCAB = f"vo AS MATERIALIZED (SELECT word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ]+')) AS word FROM documents) WHERE {_LONG})"


@query(f"""WITH {_VOCAB}, t AS MATERIALIZED (SELECT row_number() OVER () AS r, lower(text) AS text, 1 AS times FROM documents WHERE text IS NOT NULL), s AS (SELECT r, unnest(string_split(text, ' ')) AS piece FROM t),
p AS MATERIALIZED (SELECT piece, count(*) AS times FROM s GROUP BY 1),
e AS MATERIALIZED (SELECT piece, times, word, k AS n_places, (length(piece) - length(replace(piece, word, ''))) // length(word) AS n_apart
  FROM (SELECT piece, times, substr(piece, i, n) AS word, count(*) AS k FROM (SELECT piece, times, n, unnest(range(1, length(piece) - n + 2)) AS i FROM (SELECT piece, times, unnest(range(4, 13)) AS n FROM p) WHERE length(piece) >= n) GROUP BY ALL) JOIN vo USING (word)),
c AS (SELECT word, CAST(sum(times * n_places) AS BIGINT) AS n_places, CAST(sum(times * n_apart) AS BIGINT) AS n_apart FROM e GROUP BY 1),
d AS (SELECT word, count(*) AS n_texts FROM (SELECT DISTINCT r, word FROM s JOIN e USING (piece)) GROUP BY 1)
SELECT word, n_texts, n_places, n_apart FROM c JOIN d USING (word)""")
def vocabulary_counts(spark, sf_dir):
    """All words of 4 to 12 letters of the documents, counted as substrings, within other words too."""
    docs = _docs(spark, sf_dir).select(F.lower("text").alias("text"))
    vocab = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("word")).where(_LONG).distinct()
    return vocabulary.counts(docs, vocab)


@query(o.with_(_WORDS, _PHRASE) + "SELECT a || ' ' || b AS phrase, n FROM ph")
def phrase_freq(spark, sf_dir):
    return corpus.phrase_freq(_docs(spark, sf_dir))


@query(o.with_(_WORDS, _FREQ) + "SELECT count(*) AS n, round(avg(CAST(freq AS DOUBLE)), 6) AS mean_freq, round(median(CAST(freq AS DOUBLE)), 6) AS median_freq, round(quantile_cont(CAST(freq AS DOUBLE), 0.9), 6) AS p90_freq, round(avg(CAST(freq > 1 AS DOUBLE)), 6) AS repeated_share FROM f")
def lexicon_summary(spark, sf_dir):
    return corpus.lexicon_summary(_freq(spark, sf_dir))


@query(o.with_(_WORDS) + """, t AS (SELECT lang, count(*) AS n_texts, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_letters FROM documents GROUP BY 1),
u AS (SELECT lang, count(*) AS n_words, count(DISTINCT word) AS unique_words FROM w JOIN documents USING (doc_id) GROUP BY 1)
SELECT t.lang, n_texts, coalesce(n_words, 0) AS n_words, n_letters, coalesce(unique_words, 0) AS unique_words, true AS unique_holds, true AS length_50_holds, true AS length_90_holds FROM t LEFT JOIN u ON t.lang IS NOT DISTINCT FROM u.lang""")
def merged_summaries(spark, sf_dir):
    """Summaries kept by language and source, merged by language, beside exact figures: whether the sketches stay within their bounds."""
    docs = _docs(spark, sf_dir)
    parts = stored(summaries.summarised(docs, ["lang", "source"]))
    told = summaries.figures(summaries.merged(parts, ["lang"]), (0.5, 0.9)).withColumnRenamed("unique_words", "about")
    exact = docs.select("lang", F.explode(summaries.words(F.coalesce("text", F.lit("")))).alias("w")).groupBy(F.col("lang").alias("l")).agg(F.count_distinct("w").alias("unique_words"))
    size = docs.select(F.col("lang").alias("g"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    at = size.join(F.broadcast(told), size["g"].eqNullSafe(told["lang"]))
    ranks = at.groupBy(F.col("lang").alias("r")).agg(*(F.avg((F.col("size") < F.col(f"length_{q}")).cast("double")).alias(f"below_{q}") for q in (50, 90)), *(F.avg((F.col("size") <= F.col(f"length_{q}")).cast("double")).alias(f"upto_{q}") for q in (50, 90)))
    out = told.join(exact, told["lang"].eqNullSafe(exact["l"]), "left").join(ranks, told["lang"].eqNullSafe(ranks["r"]))
    holds = [((F.col(f"below_{q}") <= q / 100 + summaries.RANK_ERROR) & (F.col(f"upto_{q}") >= q / 100 - summaries.RANK_ERROR)).alias(f"length_{q}_holds") for q in (50, 90)]
    unique = F.coalesce("unique_words", F.lit(0))
    return out.select("lang", "n_texts", "n_words", "n_letters", unique.alias("unique_words"), (F.abs(F.col("about") - unique) <= summaries.DISTINCT_ERROR * unique).alias("unique_holds"), *holds)


@query(o.with_(_WORDS, _FREQ, _BLANK, _PAIRS) + "SELECT wrong, correct, w_freq, c_freq FROM cp")
def confusion_pairs(spark, sf_dir):
    return corpus.confusion_pairs(_freq(spark, sf_dir))


_SCORED = ", sc AS (SELECT *, round(ln((c_freq + 1) / CAST(w_freq + 1 AS DOUBLE)), 6) AS offline_score FROM cp)"


@query(o.with_(_WORDS, _FREQ, _BLANK, _PAIRS) + _SCORED + " SELECT wrong, correct, w_freq, c_freq, offline_score, CAST(row_number() OVER (PARTITION BY wrong ORDER BY offline_score DESC, c_freq DESC, correct) AS INTEGER) AS rank FROM sc QUALIFY rank <= 8")
def offline_score(spark, sf_dir):
    return corpus.offline_scores(corpus.confusion_pairs(_freq(spark, sf_dir)))


@query(o.with_(_WORDS, _FREQ) + """, cw AS (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ一-鿿]+')) AS word FROM conversations), cf AS (SELECT word, count(*) AS freq FROM cw GROUP BY 1)
SELECT * FROM (SELECT f.word, f.freq AS general_freq, coalesce(cf.freq, 0) AS special_freq, round(ln(f.freq + 1) / ln(coalesce(cf.freq, 0) + 2), 6) AS score FROM f LEFT JOIN cf USING (word)) WHERE score > 3""")
def high_risk_score(spark, sf_dir):
    return corpus.high_risk_scores(_freq(spark, sf_dir), corpus.word_freq(table(spark, sf_dir, "conversations")), 3.0)


@query(o.with_(_WORDS, _PHRASE, _ORDER) + "SELECT * FROM ot")
def order_templates(spark, sf_dir):
    return corpus.order_templates(_docs(spark, sf_dir))


@query(o.with_(_WORDS, _FREQ, _BLANK, _PAIRS) + """, grid(least_right, most_wrong) AS (VALUES (20, 1), (20, 2), (50, 1), (50, 2))
SELECT least_right, most_wrong, count(*) AS n_pairs, count(DISTINCT wrong) AS n_wrong FROM grid JOIN cp ON c_freq >= least_right AND w_freq <= most_wrong GROUP BY 1, 2""")
def parameter_grid(spark, sf_dir):
    return corpus.parameter_grid(spark, corpus.confusion_pairs(_freq(spark, sf_dir)), [20, 50], [1, 2])


# --- detection ----------------------------------------------------------------------------


@query(o.with_(_WORDS, _FREQ, _BLANK, _PAIRS) + ", best AS (SELECT wrong, arg_max(correct, (c_freq, correct)) AS correct FROM cp GROUP BY 1) SELECT doc_id, CAST(pos AS INTEGER) AS pos, word, correct FROM w JOIN best ON word = wrong")
def typo_scan(spark, sf_dir):
    return corpus.typo_scan(_docs(spark, sf_dir), corpus.confusion_pairs(_freq(spark, sf_dir)))


@query(o.with_(_WORDS, _PHRASE, _ORDER) + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, a || ' ' || b AS phrase, ot.correct FROM nx JOIN ot ON ot.error = a || ' ' || b WHERE b IS NOT NULL")
def order_detect(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return corpus.order_detect(d, corpus.order_templates(d))


_RULES = (("见", "可见"), ("约", "大约"), ("增生", "肥大"))
_RULE_SQL = " UNION ALL ".join(f"SELECT report_id, field, sentence_index, sentence, '{p}' AS pattern, '{s}' AS suggestion FROM sent WHERE contains(sentence, '{p}')" for p, s in _RULES)


@query(o.SENTENCES + f", e AS ({_RULE_SQL}) SELECT pattern AS error_type, field, count(*) AS n, CAST(grouping(pattern) * 2 + grouping(field) AS INTEGER) AS level FROM e GROUP BY CUBE (pattern, field)")
def error_stats(spark, sf_dir):
    e = corpus.rule_typos(en.sentences(synthetic_reports(spark, sf_dir)), _RULES)
    return corpus.error_stats(e.withColumnRenamed("pattern", "error_type"))


@query(o.SENTENCES + "SELECT report_id, field, sentence_index, replace(replace(replace(sentence, '见', '可见'), '约', '大约'), '增生', '肥大') AS corrected FROM sent WHERE regexp_matches(sentence, '见|约|增生')")
def correct_text(spark, sf_dir):
    return detect.corrected(en.sentences(synthetic_reports(spark, sf_dir)), _RULES)


# --- search, audit, history ------------------------------------------------------------------


def _store(spark, sf_dir):
    return history.structured_store(synthetic_reports(spark, sf_dir))


def _on(part: str) -> str:
    return f"list_contains(string_split(path, '>'), '{part}')"


@query(o.ENTITIES + f"SELECT report_id FROM ent WHERE {_on('肺')} AND orientation = '右' AND contains(illness, '结节') INTERSECT SELECT report_id FROM ent WHERE {_on('肾脏')} AND contains(illness, '结石')")
def nl_search_and(spark, sf_dir):
    every, some, none = history.text_query("右侧肺结节和肾脏结石")
    return history.search(_store(spark, sf_dir), every, some, none)


@query(o.ENTITIES + f"SELECT report_id FROM ent WHERE {_on('胆囊')} AND contains(illness, '壁增厚') UNION SELECT report_id FROM ent WHERE {_on('肝脏')} AND measure > 20 AND contains(illness, '囊')")
def nl_search_or(spark, sf_dir):
    some = [history.condition("胆囊", finding="壁增厚"), history.condition("肝脏", least_mm=20.0, finding="囊")]
    return history.search(_store(spark, sf_dir), some=some)


@query(o.ENTITIES + f"SELECT DISTINCT report_id FROM ent WHERE {_on('肺')} AND contains(illness, '结节') AND report_id NOT IN (SELECT report_id FROM ent WHERE {_on('胸腔')} AND contains(illness, '积液'))")
def nl_search_not(spark, sf_dir):
    every, some, none = history.text_query("肺结节,无胸腔积液")
    return history.search(_store(spark, sf_dir), every, some, none)


_VERSIONS = """, f AS (SELECT report_id, 'description' AS field, ReportStr AS t FROM syn UNION ALL SELECT report_id, 'conclusion', ConclusionStr FROM syn),
v AS (SELECT report_id, field, list_filter(string_split(t, '。'), lambda s: s <> '') AS before, list_filter(string_split(CASE report_id % 3 WHEN 0 THEN replace(t, '左', '右') WHEN 1 THEN t || '建议复查。' ELSE t END, '。'), lambda s: s <> '') AS after FROM f),
d AS (SELECT report_id, field, array_to_string(list_sort(list_distinct(list_filter(after, lambda x: NOT list_contains(before, x)))), '；') AS added, array_to_string(list_sort(list_distinct(list_filter(before, lambda x: NOT list_contains(after, x)))), '；') AS deleted FROM v)
"""


@query(o.REPORTS + _VERSIONS + "SELECT * FROM d WHERE added <> '' OR deleted <> ''")
def audit_diff_sets(spark, sf_dir):
    return history.audit_diff(history.audit_versions(synthetic_reports(spark, sf_dir)))


@query("SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def history_latest(spark, sf_dir):
    return history.history_latest(table(spark, sf_dir, "events"))


_PATIENT = ", pe AS (SELECT ent.*, o_custkey AS patient, CAST(o_orderdate AS DATE) AS day FROM ent JOIN orders ON report_id = o_orderkey)"


def _patients(spark, sf_dir):
    return history.patient_entities(synthetic_reports(spark, sf_dir), table(spark, sf_dir, "orders"))


@query(o.ENTITIES + _PATIENT + " SELECT DISTINCT patient, position, strftime(day, '%Y-%m-%d') AS day, sentence FROM (SELECT *, rank() OVER (PARTITION BY patient, position ORDER BY day DESC) AS r FROM pe WHERE positive >= 2 AND field = 'description') WHERE r = 1")
def history_summary(spark, sf_dir):
    return history.history_summary(_patients(spark, sf_dir))


@query(o.ENTITIES + _PATIENT + f""", l AS (SELECT patient, max(day) AS last_day FROM pe GROUP BY 1),
old AS (SELECT DISTINCT pe.patient, report_id, sentence, path, orientation FROM pe JOIN l USING (patient) WHERE positive = 3 AND field = 'description' AND day < last_day),
new AS (SELECT DISTINCT pe.patient, path, orientation FROM pe JOIN l USING (patient) WHERE field = 'conclusion' AND day = last_day),
hit AS (SELECT DISTINCT old.patient, old.report_id, old.sentence FROM old JOIN new ON old.patient = new.patient AND {o.related('old.path', 'new.path')} AND NOT {o.opposite('old.orientation', 'new.orientation')})
SELECT DISTINCT patient, report_id, sentence FROM old EXCEPT SELECT patient, report_id, sentence FROM hit""")
def missed_diagnosis(spark, sf_dir):
    return history.missed_diagnosis(_patients(spark, sf_dir))


@query("""SELECT event_id, strftime(try_strptime(trim(replace(regexp_replace(raw, '[一-龥]', '', 'g'), '-', '/')), '%Y/%m/%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS day
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 1 THEN '于' || strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'unknown' END AS raw FROM events)""")
def date_parse(spark, sf_dir):
    from tessera.functions.text import parse_date

    k, full = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = F.when(k == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).when(k == 1, F.concat(F.lit("于"), full)).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("unknown")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(parse_date(raw), "yyyy-MM-dd HH:mm:ss").alias("day"))


_ISLANDS = """, sp AS (SELECT DISTINCT report_id, lo, hi FROM ent WHERE field = 'description'),
m AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY report_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS fresh FROM sp),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY report_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT report_id, CAST(sum(ceil((hi - lo) / 100)) AS BIGINT) AS units FROM (SELECT report_id, island, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY 1, 2) GROUP BY 1)
"""


@query(o.ENTITIES + _ISLANDS + "SELECT report_id, units FROM u")
def interval_merge_count(spark, sf_dir):
    return history.part_units(ents(spark, sf_dir))


@query(o.ENTITIES + _ISLANDS + "SELECT syn.report_id, CAST(coalesce(units, 0) * 300 + CASE WHEN contains(StudyPart, '增强') THEN 100 ELSE 0 END + 100 AS BIGINT) AS fee FROM syn LEFT JOIN u USING (report_id)")
def fee(spark, sf_dir):
    r = synthetic_reports(spark, sf_dir)
    return history.fees(r, en.entities(r))


@query(o.ENTITIES + "SELECT report_id, string_split(path, '>')[1] AS root, array_to_string(list_sort(list(DISTINCT position)), '；') AS positions, coalesce(array_to_string(list_sort(list(DISTINCT orientation) FILTER (orientation <> '')), '；'), '') AS sides FROM ent WHERE field = 'description' GROUP BY 1, 2")
def part_summary(spark, sf_dir):
    return history.part_summary(ents(spark, sf_dir))


@query(o.ENTITIES + """, t AS (SELECT DISTINCT string_split(path, '>')[1] AS template, position FROM kg WHERE keyword = position), z AS (SELECT template, count(*) AS all_n FROM t GROUP BY 1),
g AS (SELECT report_id, template, count(DISTINCT t.position) AS n FROM ent JOIN t USING (position) WHERE field = 'description' GROUP BY 1, 2)
SELECT report_id, template, round(n / CAST(all_n AS DOUBLE), 6) AS score, CAST(row_number() OVER (PARTITION BY report_id ORDER BY round(n / CAST(all_n AS DOUBLE), 6) DESC, template) AS INTEGER) AS rank FROM g JOIN z USING (template) QUALIFY rank <= 3""")
def template_match(spark, sf_dir):
    return history.template_match(synthetic_reports(spark, sf_dir), ents(spark, sf_dir), spark)


@query(o.ENTITIES + """, a AS (SELECT DISTINCT report_id, keyword FROM ent WHERE field = 'description'), b AS (SELECT DISTINCT report_id, keyword FROM ent WHERE field = 'conclusion')
SELECT report_id, keyword, CASE WHEN a.report_id IS NULL THEN 'added' ELSE 'deleted' END AS change FROM a FULL JOIN b USING (report_id, keyword) WHERE a.report_id IS NULL OR b.report_id IS NULL""".replace("a FULL JOIN b USING (report_id, keyword) WHERE a.report_id IS NULL OR b.report_id IS NULL", "(SELECT *, 1 AS x FROM a) a FULL JOIN (SELECT *, 1 AS y FROM b) b USING (report_id, keyword) WHERE x IS NULL OR y IS NULL").replace("a.report_id IS NULL THEN", "x IS NULL THEN"))
def version_diff(spark, sf_dir):
    e = ents(spark, sf_dir)
    return history.version_diff(e.where("field = 'description'"), e.where("field = 'conclusion'"), ["report_id", "keyword"])


@query("WITH v(candidate_id, is_valid, confidence, reason) AS (VALUES " + fx.sql_list(fx.VERDICTS) + ") SELECT candidate_id, CASE WHEN is_valid IS NULL THEN 'needs_review' WHEN is_valid AND confidence >= 0.7 THEN 'keep' WHEN is_valid AND confidence >= 0.5 THEN 'weak' ELSE 'drop' END AS action FROM v")
def llm_verdicts(spark, sf_dir):
    return history.verdicts(spark)


# --- vectors, exports ---------------------------------------------------------------------------


@query("SELECT label, CAST(i AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def vector_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""WITH m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS cosine FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings) e JOIN m USING (label, i) GROUP BY 1""")
def vector_cosine(spark, sf_dir):
    return detect.cosine_to_mean(table(spark, sf_dir, "embeddings"))


@query(o.SENTENCES + f", e AS ({_RULE_SQL}) SELECT '| ' || pattern || ' | ' || suggestion || ' | ' || replace(sentence, '|', '\\|') || ' |' AS line FROM e")
def markdown_table(spark, sf_dir):
    e = corpus.rule_typos(en.sentences(synthetic_reports(spark, sf_dir)), _RULES)
    return sinks.markdown_lines(e, ["pattern", "suggestion", "sentence"])


@query()
def clause_resplit(spark, sf_dir):
    return detect.clauses(synthetic_reports(spark, sf_dir))


@query()
def illness_extract(spark, sf_dir):
    return detect.findings(synthetic_reports(spark, sf_dir))


@query()
def structured_paths(spark, sf_dir):
    return detect.disambiguated(synthetic_reports(spark, sf_dir))


# names of several nodes: the graph and those, reports that use them, and the steps one after the other
_RANGE = {p: (lo, hi) for p, _, lo, hi in fx.KG}
_SEVERAL = tuple((name, p.split(">")[-1], p, p.count(">") + 1, *_RANGE[p]) for name, paths in scan.AMBIGUOUS.items() for p in paths)
_GRAPH = Dictionaries(kg=(*fx.kg_rows(), *_SEVERAL))
_PUT = (("肺上叶", "上叶"), ("肝右叶", "右叶"), ("卵巢", "附件"))
_REPLACED = "ReportStr"
for _a, _b in _PUT:
    _REPLACED = f"replace({_REPLACED}, '{_a}', '{_b}')"
_VAGUE = f"syn AS (SELECT report_id, StudyPart, {_REPLACED} AS ReportStr FROM ({o.REPORTS_SQL}))"
_VAGUE_KG = f"kg(keyword, position, path, depth, lo, hi) AS (VALUES {fx.sql_list(_GRAPH.kg)})"
_NAMED = o.ent().replace(o.quote(fx.alternatives()), o.quote("|".join(_GRAPH.names())))
_E = "report_id, field, sentence_index, start, match_no"
_MEET = lambda a, b, f: f"({f(a + '.lo')} < {f(b + '.hi')} AND {f(b + '.lo')} < {f(a + '.hi')} AND abs({f(a + '.lo')} - {f(b + '.lo')}) <= {axis.GAP})"
_FOLD = lambda x: f"CASE WHEN {x} < {axis.FOLD} THEN {x} ELSE {x} % 100 END"


def _step(name: str, source: str, for_it: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT * EXCLUDE (ok) FROM (SELECT *, coalesce({for_it}, false) AS ok FROM {source} c) QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY {_E}))"


_STEPS = ",\n".join((
    f"base AS MATERIALIZED (SELECT {_E}, sentence, keyword, path, lo, hi, count(*) OVER (PARTITION BY {_E}) AS n_before FROM ent WHERE field = 'description')",
    "exam AS (SELECT report_id, lo, hi FROM ent WHERE field = 'title' QUALIFY path = min(path) OVER (PARTITION BY report_id, sentence_index, match_no))",
    "one AS MATERIALIZED (SELECT * FROM base WHERE n_before = 1)",
    _step("s1", "(SELECT * FROM base WHERE n_before > 1)", f"NOT ({o.has('sentence', axis.SPINE)} AND starts_with(path || '>', '{axis.NOT_SPINE}>'))"),
    _step("s2", "s1", f"EXISTS (SELECT 1 FROM exam x WHERE x.report_id = c.report_id AND {_MEET('c', 'x', str)})"),
    f"common AS (SELECT {', '.join('c.' + x for x in _E.split(', '))}, c.path FROM s2 c JOIN one x ON x.report_id = c.report_id WHERE list_has_any(string_split(c.path, '>'), string_split(x.path, '>')) QUALIFY row_number() OVER (PARTITION BY {', '.join('c.' + x for x in _E.split(', '))} ORDER BY len(list_intersect(string_split(c.path, '>'), string_split(x.path, '>'))) DESC, x.sentence_index, x.start, x.match_no, c.path) = 1)",
    _step("s3", f"(SELECT s2.*, common.path AS best FROM s2 LEFT JOIN common USING ({_E}))", "path = best"),
    _step("s4", "s3", f"EXISTS (SELECT 1 FROM one x WHERE x.report_id = c.report_id AND {_MEET('c', 'x', str)})"),
    _step("s5", "s4", f"EXISTS (SELECT 1 FROM one x WHERE x.report_id = c.report_id AND {_MEET('c', 'x', _FOLD)})"),
    _step("s6", f"(SELECT *, max(len(string_split(path, '>'))) OVER (PARTITION BY {_E}) AS most FROM s5)", "len(string_split(path, '>')) = most"),
))


@query(o.with_(_VAGUE, _VAGUE_KG, o.sent(("description", "title")), _NAMED) + ", " + _STEPS + f" SELECT {_E}, keyword, path, CAST(n_before AS INTEGER) AS n_before, CAST(count(*) OVER (PARTITION BY {_E}) AS INTEGER) AS n_after FROM (SELECT {_E}, keyword, path, n_before FROM one UNION ALL SELECT {_E}, keyword, path, n_before FROM s6)")
def disambiguate(spark, sf_dir):
    reports = synthetic_reports(spark, sf_dir)
    for a, b in _PUT:
        reports = reports.withColumn("ReportStr", F.replace("ReportStr", F.lit(a), F.lit(b)))
    every = stored(en.entities(reports, ("description", "title"), _GRAPH).select("report_id", "field", "sentence_index", "start", "match_no", "sentence", "keyword", "path", "lo", "hi"))
    first = Window.partitionBy("report_id", "sentence_index", "match_no")
    exams = every.where("field = 'title'").withColumn("first", F.min("path").over(first)).where("path = first").select("report_id", "lo", "hi")
    out = axis.disambiguated(every.where("field = 'description'"), exams)
    return out.select("report_id", "field", "sentence_index", "start", "match_no", "keyword", "path", "n_before", "n_after")


@query()
def hierarchical_merge(spark, sf_dir):
    return detect.merged(synthetic_reports(spark, sf_dir))


@query()
def clause_match(spark, sf_dir):
    return detect.best_clauses(synthetic_reports(spark, sf_dir))


_MARKED = "|".join(sorted(scan.dictionary().entries, key=lambda n: (-len(n), n)))


@query(o.REPORTS + f"SELECT report_id, regexp_replace(replace(replace(replace(ReportStr, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '({_MARKED})', '<span class=\"part\">\\1</span>', 'g') AS html FROM syn")
def highlight_html(spark, sf_dir):
    return detect.highlighted(synthetic_reports(spark, sf_dir))
