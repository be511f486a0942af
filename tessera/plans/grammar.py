"""Queries of the grammar part: a corpus of clean reports, its lexicons, and typed reports that hold errors."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.operators import checks, corpus, entities as en, extra, grammar as g, language_model as lm, sounds, vocabulary, word_vectors
from tessera.plans import oracle as o
from tessera.plans.queries import query
from tessera.scratch import stored
from tessera.sources.reports import synthetic_reports

LEAST_RIGHT, LEAST_ORDER, LEAST_VOCAB = 20, 20, 20

# --- the rows, in Spark and in SQL -----------------------------------------------------------


def typed(reports):
    """Reports as typed: errors put in by remainders of the key."""
    k = F.pmod("report_id", F.lit(6))
    r = lambda t, a, b: F.replace(t, F.lit(a), F.lit(b))

    def spoil(c):
        t = F.col(c)
        return F.when(k == 0, r(r(r(t, "纹理", "文里"), "结节", "节节"), "结石", "节石")).when(k == 1, r(r(t, "骨质增生", "增生骨质"), "明显强化", "强化明显")).when(k == 2, r(r(t, "密度", "密渡"), "未见", "末见")).when(k == 3, r(t, "，", "，，")).when(k == 4, F.concat(t, F.lit("请赴仁济堂医院复查。"))).otherwise(t)

    return reports.withColumn("ReportStr", spoil("ReportStr")).withColumn("ConclusionStr", spoil("ConclusionStr"))


def _spoil(c: str) -> str:
    return f"CASE report_id % 6 WHEN 0 THEN replace(replace(replace({c}, '纹理', '文里'), '结节', '节节'), '结石', '节石') WHEN 1 THEN replace(replace({c}, '骨质增生', '增生骨质'), '明显强化', '强化明显') WHEN 2 THEN replace(replace({c}, '密度', '密渡'), '未见', '末见') WHEN 3 THEN replace({c}, '，', '，，') WHEN 4 THEN {c} || '请赴仁济堂医院复查。' ELSE {c} END"


VOCAB = g.vocabulary()
_TYPED = f"typed AS (SELECT report_id, {_spoil('ReportStr')} AS ReportStr, {_spoil('ConclusionStr')} AS ConclusionStr FROM syn)"


#: Words with their numbers of places in the clean sentences, one more each, and what they cost; then every sentence cut
#: from its end: the cheapest way from each place on, the longer word of equally cheap ones.
_CUT = f"""vw(word) AS (VALUES {', '.join(f"('{w}')" for w in VOCAB)}), us AS MATERIALIZED (SELECT sentence, count(*) AS times FROM sent GROUP BY 1),
wn AS MATERIALIZED (SELECT word, CAST(1 + sum(times * len(list_filter(range(1, length(sentence) + 1), lambda i: substr(sentence, i, length(word)) = word))) AS BIGINT) AS freq FROM vw CROSS JOIN us GROUP BY 1),""" + """
wk AS MATERIALIZED (SELECT map_from_entries(list((word, CAST(round(1e6 * ln(total / freq)) AS BIGINT)))) AS m, CAST(round(1e6 * ln(any_value(total))) AS BIGINT) AS none, max(length(word)) AS most
  FROM wn CROSS JOIN (SELECT CAST(sum(freq) AS DOUBLE) AS total FROM wn)),
cut(sentence, i, best, toks) AS (
  SELECT sentence, CAST(length(sentence) + 1 AS BIGINT), [CAST(0 AS BIGINT)], [CAST([] AS VARCHAR[])] FROM (SELECT sentence FROM sent UNION SELECT sentence FROM ts)
  UNION ALL
  SELECT sentence, i - 1, list_prepend(pick.c, best), list_prepend(list_prepend(substr(sentence, i - 1, -pick.l), toks[-pick.l]), toks)
  FROM (SELECT sentence, i, best, toks, list_min(list_concat([{'c': none + best[k], 'l': -k}],
      list_transform(list_filter(range(1, least(most, length(sentence) - i + 2) + 1), lambda n: map_contains(m, substr(sentence, i - 1, n))), lambda n: {'c': m[substr(sentence, i - 1, n)] + best[n], 'l': -n}))) AS pick
    FROM (SELECT *, length(regexp_extract(substr(sentence, i - 1), '^([A-Za-z0-9.]+|.)')) AS k FROM cut CROSS JOIN wk WHERE i > 1))),
tk AS MATERIALIZED (SELECT sentence, toks[1] AS tokens FROM cut WHERE i = 1)"""


def _tok(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {source}.*, tokens FROM {source} JOIN tk USING (sentence))"


_FREQ = "fr AS MATERIALIZED (SELECT word, count(*) AS freq FROM (SELECT unnest(tokens) AS word FROM ct) WHERE regexp_matches(word, '^[一-鿿]+$') GROUP BY 1)"
_BASE = o.with_(o.SYN, o.sent(), _TYPED, o.sent(name="ts").replace("FROM syn", "FROM typed"), _CUT, _tok("ct", "sent"), _tok("tt", "ts"), _FREQ).replace("WITH ", "WITH RECURSIVE ", 1)
_HOM = fx.sql_list([(c, h) for c, hs in extra.HOMOPHONES.items() for h in hs])
_HEAD: dict[str, str] = {}
for _c, _hs in extra.HOMOPHONES.items():
    for _x in (_c, *_hs):
        _HEAD.setdefault(_x, _HEAD.get(_c, _c))


def _syl(x: str) -> str:
    return f"translate({x}, '{''.join(_HEAD)}', '{''.join(_HEAD.values())}')"


def _put(word: str, at: str, ch: str) -> str:
    return f"substr({word}, 1, {at} - 1) || {ch} || substr({word}, {at} + 1)"


_VARIANTS = f"""hom(ch, other) AS (VALUES {_HOM}),
va_at AS (SELECT word, i, other FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM fr WHERE freq >= {LEAST_RIGHT} AND length(word) BETWEEN 2 AND 8) JOIN hom ON substr(word, i, 1) = ch),
va AS (SELECT DISTINCT word, variant FROM (SELECT word, {_put('word', 'i', 'other')} AS variant FROM va_at
  UNION ALL SELECT word, {_put('(' + _put('word', 'i', 'o1') + ')', 'j', 'o2')} FROM (SELECT a.word, a.i, a.other AS o1, b.i AS j, b.other AS o2 FROM va_at a JOIN va_at b ON a.word = b.word AND a.i < b.i AND b.i - a.i <= 3
    QUALIFY row_number() OVER (PARTITION BY a.word ORDER BY a.i, b.i, a.other, b.other) <= 200)) WHERE variant <> word)"""
_RAW = "rawg AS MATERIALIZED (SELECT gram, count(*) AS k FROM (SELECT substr(sentence, i, n) AS gram FROM (SELECT sentence, n, unnest(range(1, length(sentence) - n + 2)) AS i FROM (SELECT sentence, unnest(range(2, 9)) AS n FROM ts) WHERE length(sentence) >= n)) GROUP BY 1)"
_CONF = f"""cf AS MATERIALIZED (SELECT variant AS wrong, va.word AS correct, coalesce(w.freq, 0) AS w_freq, c.freq AS c_freq, coalesce(k, 0) AS raw_freq
  FROM va JOIN fr c ON c.word = va.word LEFT JOIN fr w ON w.word = variant LEFT JOIN rawg ON gram = variant
  WHERE coalesce(w.freq, 0) <= 50 AND levenshtein({_syl('variant')}, {_syl('va.word')}) <= 2 AND NOT (coalesce(w.freq, 0) = 0 AND coalesce(k, 0) < 1))"""
_RISK = f"rk AS MATERIALIZED (SELECT * FROM (SELECT w.word, round(ln(general + 1) / ln(coalesce(freq, 0) + 2), 6) AS score FROM (VALUES {fx.sql_list(fx.GENERAL)}) w(word, general, pos) LEFT JOIN fr USING (word)) WHERE score > 2.0)"
_RAW4 = "cg4 AS MATERIALIZED (SELECT gram, count(*) AS k FROM (SELECT substr(sentence, i, 4) AS gram FROM (SELECT sentence, unnest(range(1, length(sentence) - 2)) AS i FROM sent WHERE length(sentence) >= 4)) GROUP BY 1)"
_PATT = f"""op AS MATERIALIZED (SELECT * FROM (SELECT w.word AS correct, substr(w.word, 3, 2) || substr(w.word, 1, 2) AS error, substr(w.word, 1, 2) AS part1, substr(w.word, 3, 2) AS part2, w.freq AS correct_freq, coalesce(e.freq, 0) AS error_freq,
    round(w.freq / CAST(coalesce(e.freq, 0) + 1 AS DOUBLE), 6) AS ratio, coalesce(a.k, 0) AS raw_correct, coalesce(b.k, 0) AS raw_error
  FROM fr w LEFT JOIN fr e ON e.word = substr(w.word, 3, 2) || substr(w.word, 1, 2) LEFT JOIN cg4 a ON a.gram = w.word LEFT JOIN cg4 b ON b.gram = substr(w.word, 3, 2) || substr(w.word, 1, 2)
  WHERE length(w.word) = 4 AND w.freq >= {LEAST_ORDER}) WHERE error <> correct AND error_freq <= 20 AND ratio >= 20 AND raw_error <= 50 AND raw_correct / CAST(raw_error + 1 AS DOUBLE) >= 5)"""
_SUBS = "su AS (SELECT DISTINCT ch, other FROM (SELECT wrong, correct, count(*) AS n, min(substr(wrong, i, 1)) AS ch, min(substr(correct, i, 1)) AS other FROM (SELECT wrong, correct, unnest(range(1, length(wrong) + 1)) AS i FROM cf WHERE length(wrong) = length(correct)) WHERE substr(wrong, i, 1) <> substr(correct, i, 1) GROUP BY 1, 2) WHERE n = 1)"


def kn_sql(source: str, text: str, others: str, order: int = lm.ORDER, prune: tuple[int, ...] = lm.PRUNE) -> str:
    """Tables that end in kp (gram, p) and kx (head, all_, free): the language model of a column of a table."""
    fall = lm.FALLBACK
    ok = "t1 > 0 AND t2 > 0 AND t3 > 0 AND t4 > 0 AND 1 - 2 * y * t2 / t1 BETWEEN 0 AND 1 AND 2 - 3 * y * t3 / t2 BETWEEN 0 AND 2 AND 3 - 4 * y * t4 / t3 BETWEEN 0 AND 3"
    d = [f"CASE WHEN {ok} THEN {k} - {k + 1} * y * t{k + 1} / t{k} ELSE {fall[k - 1]} END AS d{k}" for k in (1, 2, 3)]
    t = ", ".join(f"CAST(count(*) FILTER (a = {k}) AS DOUBLE) AS t{k}" for k in (1, 2, 3, 4))
    keep = "c > CASE n " + " ".join(f"WHEN {n} THEN {p}" for n, p in enumerate(prune[:order], 1)) + " END"
    out = f"""kt AS (SELECT chr(2) || t || chr(3) AS t, times FROM (SELECT regexp_replace({text}, '{others}', '', 'g') AS t, count(*) AS times FROM {source} GROUP BY 1) WHERE t <> ''),
kr AS MATERIALIZED (SELECT gram, length(gram) AS n, CAST(sum(times) AS BIGINT) AS c FROM (SELECT substr(t, i, n) AS gram, times FROM (SELECT t, times, n, unnest(range(1, length(t) - n + 2)) AS i FROM (SELECT t, times, unnest(range(1, {order + 1})) AS n FROM kt) WHERE length(t) >= n)) WHERE gram <> chr(2) GROUP BY 1),
kb AS (SELECT substr(gram, 2) AS gram, count(*) AS kinds FROM kr WHERE n > 1 GROUP BY 1),
ka AS MATERIALIZED (SELECT kr.gram, n, c, CASE WHEN n = {order} OR starts_with(kr.gram, chr(2)) THEN c ELSE kinds END AS a FROM kr LEFT JOIN kb USING (gram)),
kd AS (SELECT n, {', '.join(d)} FROM (SELECT *, t1 / (t1 + 2 * t2) AS y FROM (SELECT n, {t} FROM ka GROUP BY 1))),
kf AS MATERIALIZED (SELECT *, CASE WHEN keep THEN off ELSE a END AS free FROM (SELECT gram, n, a, {keep} AS keep, CASE a WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS off FROM ka JOIN kd USING (n))),
kx AS MATERIALIZED (SELECT left(gram, n - 1) AS head, CAST(sum(a) AS DOUBLE) AS all_, CAST(sum(free) AS DOUBLE) AS free, count(*) AS kinds FROM kf GROUP BY 1),
kp0 AS (SELECT '' AS gram, free / all_ / (kinds + 1) AS p FROM kx WHERE head = ''),
kp1 AS MATERIALIZED (SELECT gram, (a - off) / all_ + free / all_ / (kinds + 1) AS p FROM (SELECT kf.gram, a, off, x.free, all_, kinds FROM kf JOIN kx x ON x.head = '' WHERE n = 1 AND keep))"""
    for n in range(2, order + 1):
        out += f",\nkp{n} AS MATERIALIZED (SELECT kf.gram, (a - off) / all_ + x.free / all_ * p AS p FROM kf JOIN kx x ON x.head = left(kf.gram, {n - 1}) JOIN kp{n - 1} l ON l.gram = substr(kf.gram, 2) WHERE n = {n} AND keep)"
    return out + ",\nkp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM kp{n}" for n in range(order + 1)) + ")"


def lm_sql(texts: str, others: str, order: int = lm.ORDER) -> str:
    """(text, lm) of a table of distinct texts."""
    return f"""(SELECT text, round(coalesce(sum(s), 0), 6) AS lm FROM (SELECT text FROM {texts}) q LEFT JOIN (SELECT text, i, max(CASE WHEN k = best THEN log10(coalesce(p, (SELECT p FROM kp0))) END) + coalesce(sum(CASE WHEN k > best AND head <> '' THEN log10(free / all_) END), 0) AS s FROM (
      SELECT text, i, k, kp.p, x.head, x.free, x.all_, coalesce(max(CASE WHEN kp.p IS NOT NULL THEN k END) OVER (PARTITION BY text, i), 1) AS best
      FROM (SELECT text, t, i, unnest(range(1, least(i, {order}) + 1)) AS k FROM (SELECT text, t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT text, regexp_replace(text, '{others}', '', 'g') AS t FROM {texts})))
        LEFT JOIN kp ON kp.gram = substr(t, i - k + 1, k) LEFT JOIN kx x ON x.head = substr(t, i - k + 1, k - 1)) GROUP BY 1, 2) USING (text) GROUP BY 1)"""


_OTHERS = "[^一-鿿]"
_GRAMS = kn_sql("sent", "sentence", _OTHERS)
LEXICONS = _BASE.rstrip() + ",\n" + ",\n".join((_VARIANTS, _RAW, _CONF, _RISK, _RAW4, _PATT, _SUBS, _GRAMS)) + "\n"


def _pieces(source: str, most: int) -> str:
    return f"""(SELECT *, array_to_string(tokens[first:first + n - 1], '') AS piece, CASE WHEN first > 1 THEN length(array_to_string(tokens[1:first - 1], '')) ELSE 0 END AS start,
    CASE WHEN first > 1 THEN tokens[first - 1] ELSE '' END AS before, coalesce(tokens[first + n], '') AS after
  FROM (SELECT *, unnest(range(1, least({most}, len(tokens) - first + 1) + 1)) AS n FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS first FROM {source})))"""


_K = "report_id, field, sentence_index"
_SUF = " OR ".join(f"(ends_with(piece, '{s}') AND length(piece) - {len(s)} >= 3 AND substr(piece, 1, length(piece) - {len(s)}) = rk.word)" for s in fx.SUFFIXES)
_SCAN = f""", pc AS MATERIALIZED (SELECT {_K}, sentence, first, n, piece, start, before, after FROM {_pieces('tt', 4)}),
bc AS (SELECT wrong, arg_max(correct, (c_freq, correct)) AS correct FROM cf GROUP BY 1),
kn AS (SELECT pc.*, bc.correct AS suggestion, CAST(NULL AS DOUBLE) AS score FROM pc JOIN bc ON piece = wrong), ri AS (SELECT pc.*, CAST(NULL AS VARCHAR) AS suggestion, rk.score FROM pc JOIN rk ON piece = rk.word),
runs AS (SELECT * FROM (SELECT *, 'typo' AS kind, 4 AS rank FROM kn UNION ALL SELECT *, 'general_high_risk', 5 FROM ri) WHERE n BETWEEN 2 AND 4 AND length(piece) = n AND NOT regexp_matches(piece, '[{fx.BLOCKED}]')
  QUALIFY row_number() OVER (PARTITION BY {_K}, first ORDER BY n, rank) = 1),
sc AS MATERIALIZED (SELECT {_K}, sentence, start, start + length(piece) AS stop, piece AS error, suggestion, kind, score, before, after FROM (
  SELECT *, 'typo' AS kind, 1 AS rank FROM kn WHERE n = 1 UNION ALL SELECT *, 'general_high_risk', 2 FROM ri WHERE n = 1
  UNION ALL SELECT pc.*, CAST(NULL AS VARCHAR), rk.score, 'general_high_risk', 3 FROM pc JOIN rk ON {_SUF} WHERE n = 1 AND length(piece) >= 4
  UNION ALL SELECT * FROM runs UNION ALL SELECT *, 'general_high_risk', 6 FROM ri WHERE n BETWEEN 2 AND 3 AND length(piece) <= 10) QUALIFY row_number() OVER (PARTITION BY {_K}, start, piece ORDER BY rank) = 1)
"""


def _lm(texts: str) -> str:
    return lm_sql(texts, _OTHERS)


_CTX = lambda s, a, b: f"regexp_extract(substr({s}, 1, CAST({a} AS BIGINT)), '[^{g.CLAUSE_MARKS}]*$') || substr({s}, CAST({a} AS BIGINT) + 1, CAST({b} - {a} AS BIGINT)) || regexp_extract(substr({s}, CAST({b} AS BIGINT) + 1), '^[^{g.CLAUSE_MARKS}]*')"
_NEED = "NOT regexp_matches(error, '[0-9A-Za-z]') AND NOT regexp_matches(coalesce(suggestion, ''), '[0-9A-Za-z]')"
_DETECT = _SCAN + f"""
, s1 AS (SELECT * FROM sc WHERE {_NEED} AND (kind = 'typo' OR score >= {g.RISK_SCORE})),
cand AS MATERIALIZED (SELECT DISTINCT {_K}, sentence, start, start + length(error) AS stop, error, before, after, suggestion FROM (
  SELECT b.*, {_put('error', 'i', 'other')} AS suggestion FROM (SELECT {_K}, sentence, start, piece AS error, before, after, unnest(range(1, length(piece) + 1)) AS i FROM pc WHERE n = 1 AND regexp_matches(piece, '^[一-鿿]+$') AND length(piece) BETWEEN 2 AND 8 AND (before <> '' OR after <> '')) b
  JOIN su ON substr(error, i, 1) = ch) c JOIN fr ON fr.word = suggestion AND fr.freq >= {LEAST_VOCAB}),
asked AS (SELECT DISTINCT unnest([before || error || after, before || suggestion || after]) AS text FROM (SELECT before, error, after, suggestion FROM s1 WHERE suggestion IS NOT NULL UNION ALL SELECT before, error, after, suggestion FROM cand)),
lm AS MATERIALIZED {_lm('asked')},
s2 AS (SELECT s1.* FROM s1 LEFT JOIN lm a ON a.text = before || error || after LEFT JOIN lm b ON b.text = before || suggestion || after WHERE suggestion IS NULL OR (before = '' AND after = '') OR round(b.lm - a.lm, 6) > {g.REJECT}),
ex AS (SELECT * FROM (SELECT cand.*, round(b.lm - a.lm, 6) AS delta FROM cand JOIN lm a ON a.text = before || error || after JOIN lm b ON b.text = before || suggestion || after
  WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.report_id = cand.report_id AND s2.field = cand.field AND s2.sentence_index = cand.sentence_index AND s2.start = cand.start AND s2.stop = cand.stop))
  WHERE delta >= {g.ACCEPT} QUALIFY row_number() OVER (PARTITION BY {_K}, start, stop ORDER BY delta DESC, suggestion) = 1)"""
_ORDER = f"""
, wo AS MATERIALIZED (SELECT DISTINCT {_K}, sentence, start, start + length(piece) AS stop, piece AS error, op.correct AS suggestion, op.ratio FROM {_pieces('tt', g.ORDER_TOKENS)} p JOIN op ON op.error = piece
  LEFT JOIN fr a ON a.word = part1 LEFT JOIN fr b ON b.word = part2
  WHERE length(piece) <= {g.ORDER_CHARS} AND NOT contains(sentence, op.correct)
    AND (len(list_filter(range(1, n + 1), lambda k: array_to_string(tokens[first:first + k - 1], '') = part2)) > 0 OR (n = 1 AND greatest(coalesce(a.freq, 0), coalesce(b.freq, 0)) >= 5)))"""
_ALL = _DETECT + _ORDER + f"""
, de AS MATERIALIZED (SELECT {_K}, start, stop, error, suggestion, error_type, {_CTX('sentence', 'start', 'stop')} AS context, score, rule_source FROM (
  SELECT {_K}, sentence, start, stop, error, suggestion, kind AS error_type, score, CASE kind WHEN 'typo' THEN 'direct_confusion' ELSE 'high_risk_lexicon' END AS rule_source, 1 AS rank FROM s2
  UNION ALL SELECT {_K}, sentence, start, stop, error, suggestion, 'typo', delta, 'expanded_candidate', 2 FROM ex
  UNION ALL SELECT {_K}, sentence, start, stop, error, suggestion, 'word_order', ratio, 'word_order_template', 3 FROM wo WHERE length(regexp_replace({_CTX('sentence', 'start', 'stop')}, '\\s+', '', 'g')) >= length(error) + 2 AND ratio >= {g.ORDER_RATIO})
  QUALIFY row_number() OVER (PARTITION BY {_K}, start, stop ORDER BY rank, error_type) = 1)
"""


def word_costs(spark, sf_dir):
    """Of the words in the clean sentences."""
    return vocabulary.word_costs(en.sentences(synthetic_reports(spark, sf_dir)), VOCAB)


def clean_tokens(spark, sf_dir, cost=None):
    """(sentence, times, tokens): the different clean sentences."""
    return vocabulary.segmented(g.different(en.sentences(synthetic_reports(spark, sf_dir))), cost or word_costs(spark, sf_dir))


def typed_tokens(spark, sf_dir, cost=None):
    """The sentences as typed with their tokens; each different one is cut once."""
    rows = en.sentences(typed(synthetic_reports(spark, sf_dir)))
    each = stored(vocabulary.segmented(g.different(rows).drop("times"), cost or word_costs(spark, sf_dir)))
    return rows.join(each, "sentence").select(*g.KEYS, "sentence", "tokens")


class Lexicons:
    """What is mined from the clean corpus and the typed sentences, each table written once, when it is asked for."""

    def __init__(self, spark, sf_dir):
        cost = word_costs(spark, sf_dir)
        self.clean, self.rows = stored(clean_tokens(spark, sf_dir, cost)), typed_tokens(spark, sf_dir, cost)
        self.freq = stored(g.token_freq(self.clean))  # tables of lexicons are small; sentences come with their tokens

    @cached_property
    def pairs(self):
        return stored(g.confusions(self.freq, self.rows, LEAST_RIGHT))

    @cached_property
    def risk(self):
        return g.high_risk(self.freq)

    @cached_property
    def patterns(self):
        return stored(g.order_patterns(self.freq, self.clean, LEAST_ORDER, ratio=20.0))

    @cached_property
    def grams(self):
        return stored(lm.train(self.clean))

    def detected(self):
        return g.detect(self.rows, self.pairs, self.risk, self.patterns, self.freq, self.grams, LEAST_VOCAB)


# --- queries ----------------------------------------------------------------------------------


@query(_BASE + f"SELECT {_K}, CAST(k - 1 AS INTEGER) AS token_no, tokens[k] AS token, CAST(coalesce(length(array_to_string(tokens[1:k - 1], '')), 0) AS INTEGER) AS start FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS k FROM tt)")
def segment_tokens(spark, sf_dir):
    p = g.pieces(typed_tokens(spark, sf_dir), 1)
    return p.select(*g.KEYS, (F.col("first") - 1).cast("int").alias("token_no"), F.col("piece").alias("token"), F.col("start").cast("int").alias("start"))


@query(_BASE + "SELECT word, freq FROM fr")
def report_word_freq(spark, sf_dir):
    return g.token_freq(clean_tokens(spark, sf_dir))


@query(LEXICONS + "SELECT word, variant FROM va")
def confusion_variants(spark, sf_dir):
    f = g.token_freq(clean_tokens(spark, sf_dir)).where((F.col("freq") >= LEAST_RIGHT) & F.length("word").between(2, 8))
    return g.variants(f.select("word"))


@query(LEXICONS + "SELECT wrong, correct, w_freq, c_freq, raw_freq FROM cf")
def confusion_lexicon(spark, sf_dir):
    return Lexicons(spark, sf_dir).pairs


_NEAR = ", ".join(f"('{a}~{b}', {c})" for a in sorted({y for _, y in fx.SOUNDS}) for b in sorted({y for _, y in fx.SOUNDS}) if (c := sounds.cost(a, b)) < 1)


@query(_BASE.rstrip() + f""",
so(ch, syllable) AS (VALUES {fx.sql_list(fx.SOUNDS)}), tf AS MATERIALIZED (SELECT word, count(*) AS freq FROM (SELECT unnest(tokens) AS word FROM tt) WHERE length(word) BETWEEN 2 AND 8 GROUP BY 1),
sw AS MATERIALIZED (SELECT word, freq, list(syllable ORDER BY i) AS s FROM (SELECT word, freq, i, substr(word, i, 1) AS ch FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM tf)) JOIN so USING (ch) GROUP BY 1, 2 HAVING count(*) = length(word)),
nr AS (SELECT map_from_entries(list((k, v))) AS m FROM (VALUES {_NEAR}) x(k, v)),
ds AS (SELECT a.word AS wrong, b.word AS correct, a.freq AS w_freq, b.freq AS c_freq, list_reduce(range(1, len(a.s) + 1), lambda row, i: list_reduce(range(1, len(b.s) + 1), lambda acc, j:
    list_append(acc, least(row[j + 1] + 1, acc[j] + 1, row[j] + coalesce(m[a.s[i] || '~' || b.s[j]], 1))), [CAST(i AS DOUBLE)]), list_transform(range(0, len(b.s) + 1), lambda x: CAST(x AS DOUBLE))) AS d
  FROM sw a JOIN sw b ON a.word <> b.word AND a.freq <= 20000 AND b.freq >= {LEAST_RIGHT} CROSS JOIN nr)
SELECT wrong, correct, w_freq, c_freq, d[len(d)] AS distance FROM ds WHERE d[len(d)] <= 2""")
def sound_confusions(spark, sf_dir):
    """Words of the typed sentences that sound alike."""
    freq = typed_tokens(spark, sf_dir).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    return sounds.sound_confusions(stored(freq), spark.createDataFrame(list(fx.SOUNDS), "char string, syllable string"), LEAST_RIGHT, 20000, 2.0)


@query(LEXICONS + "SELECT ch, other FROM su")
def substitution_map(spark, sf_dir):
    return g.substitutions(Lexicons(spark, sf_dir).pairs)


@query(LEXICONS + "SELECT word, score FROM rk")
def risk_lexicon(spark, sf_dir):
    return Lexicons(spark, sf_dir).risk


@query(LEXICONS + "SELECT correct, error, part1, part2, correct_freq, error_freq, ratio, raw_correct, raw_error FROM op")
def order_lexicon(spark, sf_dir):
    return Lexicons(spark, sf_dir).patterns


@query(LEXICONS + f", pr AS (SELECT DISTINCT substr(word, i, 2) AS word FROM (SELECT word, unnest(range(1, length(word))) AS i FROM fr WHERE length(word) BETWEEN 2 AND 6 AND freq >= {LEAST_RIGHT})) SELECT substr(pr.word, 1, 1) AS first, substr(pr.word, 2, 1) AS second, f.freq AS forward, coalesce(b.freq, 0) AS backward FROM pr JOIN fr f ON f.word = pr.word LEFT JOIN fr b ON b.word = reverse(pr.word) WHERE f.freq >= {LEAST_RIGHT} AND coalesce(b.freq, 0) <= 20")
def order_bigrams(spark, sf_dir):
    return g.bigram_templates(g.token_freq(clean_tokens(spark, sf_dir)), LEAST_RIGHT)


_MODEL = "SELECT kp.gram, CAST(length(kp.gram) AS INTEGER) AS n, round(p, 9) AS p, CASE WHEN kp.gram <> '' THEN round(x.free / all_, 9) END AS backoff FROM (SELECT * FROM kp UNION ALL SELECT chr(2), 0) kp LEFT JOIN kx x ON x.head = kp.gram"


def _rounded(model):
    return model.select("gram", "n", F.round("p", 9).alias("p"), F.round("backoff", 9).alias("backoff"))


@query(LEXICONS + _MODEL)
def language_model(spark, sf_dir):
    return _rounded(lm.train(clean_tokens(spark, sf_dir)))


@query(LEXICONS + f"SELECT text, lm FROM {_lm('(SELECT DISTINCT sentence AS text FROM ts)')}")
def language_scores(spark, sf_dir):
    cost = word_costs(spark, sf_dir)
    rows = typed_tokens(spark, sf_dir, cost).select(F.col("sentence").alias("text")).distinct()
    return lm.scores(rows, stored(lm.train(clean_tokens(spark, sf_dir, cost))))


_LETTERS, _LINES = "[^a-zà-ÿ ]", "li AS MATERIALIZED (SELECT unnest(string_split_regex(lower(text), '[.\\n]+')) AS line FROM documents WHERE lang <> 'de')"


def _letters(spark, sf_dir, where):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(where)
    lines = docs.select(F.explode(F.split(F.lower("text"), "[.\\n]+")).alias("line"))
    return lm.train(lines, text="line", others="[^a-z\\u00e0-\\u00ff ]")


@query(o.with_(_LINES, kn_sql("li", "line", _LETTERS)) + _MODEL)
def letter_model(spark, sf_dir):
    """A model of letters of the lines and sentences of all documents but the German ones."""
    return _rounded(_letters(spark, sf_dir, "lang <> 'de'"))


@query(o.with_(_LINES, kn_sql("li", "line", _LETTERS)) + f"SELECT text, lm FROM {lm_sql('(SELECT DISTINCT lower(text) AS text FROM conversations WHERE text IS NOT NULL)', _LETTERS)}")
def letter_scores(spark, sf_dir):
    """What that model says of every turn of a conversation."""
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL").select(F.lower("text").alias("text")).distinct()
    return lm.scores(texts, stored(_letters(spark, sf_dir, "lang <> 'de'")), others="[^a-z\\u00e0-\\u00ff ]")


@query(LEXICONS + _SCAN + f"SELECT {_K}, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, error, suggestion, kind, score FROM sc")
def lexicon_scan(spark, sf_dir):
    x = Lexicons(spark, sf_dir)
    out = g.scan(x.rows, g.best_corrections(x.pairs), x.risk)
    return out.select(*g.KEYS, F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "error", "suggestion", "kind", "score")


_ONE = LEXICONS.replace(_SUBS, "c1 AS (SELECT * FROM cf WHERE correct = '结节'),\n" + _SUBS.replace("FROM cf ", "FROM c1 ")) + _DETECT.replace("FROM cf ", "FROM c1 ")


@query(_ONE + f"SELECT {_K}, CAST(start AS INTEGER) AS start, error, suggestion, delta FROM ex")
def expanded_typos(spark, sf_dir):
    """What one known pair leads to: its swapped character in other words."""
    x = Lexicons(spark, sf_dir)
    x.pairs = x.pairs.where("correct = '结节'")
    each = stored(g.first_rows(x.rows))
    found = g.scan(each, g.best_corrections(x.pairs), x.risk).where((F.col("kind") == "typo") | (F.col("score") >= g.RISK_SCORE))
    out = g.expanded(each, g.plausible(found, x.grams), g.substitutions(x.pairs), x.freq, x.grams, LEAST_VOCAB)
    return g.of_all(x.rows, out).select(*g.KEYS, F.col("start").cast("int").alias("start"), "error", "suggestion", "delta")


@query(LEXICONS + _ORDER + f"SELECT {_K}, CAST(start AS INTEGER) AS start, error, suggestion, ratio FROM wo")
def word_order_scan(spark, sf_dir):
    x = Lexicons(spark, sf_dir)
    return g.of_all(x.rows, g.wrong_order(stored(g.first_rows(x.rows)), x.patterns, x.freq)).select(*g.KEYS, F.col("start").cast("int").alias("start"), "error", "suggestion", "ratio")


@query(LEXICONS + _ALL + f"SELECT {_K}, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, error, suggestion, error_type, context, score, rule_source FROM de")
def grammar_errors(spark, sf_dir):
    out = Lexicons(spark, sf_dir).detected()
    return out.withColumn("start", F.col("start").cast("int")).withColumn("stop", F.col("stop").cast("int"))


@query(LEXICONS + _ALL + "SELECT error_type, field, count(*) AS n, CAST(grouping(error_type) * 2 + grouping(field) AS INTEGER) AS level FROM de GROUP BY CUBE (error_type, field)")
def grammar_stats(spark, sf_dir):
    return corpus.error_stats(Lexicons(spark, sf_dir).detected())


_FIXED = (LEXICONS + _ALL) + f"""
, sg AS MATERIALIZED (SELECT {_K}, start, stop, suggestion, row_number() OVER (PARTITION BY {_K} ORDER BY start DESC, stop, suggestion) AS rn FROM de WHERE suggestion IS NOT NULL),
fx(report_id, field, sentence_index, rn, t, edge) AS (
  SELECT DISTINCT sg.report_id, sg.field, sg.sentence_index, CAST(0 AS BIGINT), sentence, CAST(length(sentence) AS BIGINT) FROM sg JOIN tt USING ({_K})
  UNION ALL
  SELECT fx.report_id, fx.field, fx.sentence_index, sg.rn, CASE WHEN stop <= edge THEN substr(t, 1, CAST(start AS BIGINT)) || suggestion || substr(t, CAST(stop AS BIGINT) + 1) ELSE t END, CAST(CASE WHEN stop <= edge THEN start ELSE edge END AS BIGINT)
  FROM fx JOIN sg ON sg.report_id = fx.report_id AND sg.field = fx.field AND sg.sentence_index = fx.sentence_index AND sg.rn = fx.rn + 1)
SELECT {_K}, t AS corrected FROM fx QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY rn DESC) = 1"""


@query(_FIXED)
def corrected_reports(spark, sf_dir):
    x = Lexicons(spark, sf_dir)
    return g.corrected(x.rows, x.detected())


_RULES = " UNION ALL ".join(f"SELECT {_K}, unnest({o.found('sentence', p)}) AS hit, {o.quote(s)} AS suggestion, {o.quote(d)} AS description FROM ts" for p, s, d in fx.TYPO_RULES)
_KNOWN = "kg3 AS (SELECT gram FROM (SELECT substr(t, i, 3) AS gram FROM (SELECT t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT regexp_replace(sentence, '[^一-龥]', '', 'g') AS t FROM sent) WHERE length(t) >= 3)) GROUP BY 1 HAVING count(*) >= 5)"
_LOST = f"an AS (SELECT {_K}, i - 1 AS position, a.gram, substr(t, greatest(1, i - 3), i + 6 - greatest(1, i - 3)) AS context FROM (SELECT {_K}, t, i, substr(t, i, 3) AS gram FROM (SELECT *, unnest(range(1, length(t) - 1)) AS i FROM (SELECT {_K}, regexp_replace(sentence, '[^一-龥]', '', 'g') AS t FROM ts) WHERE length(t) >= 3)) a ANTI JOIN kg3 ON a.gram = kg3.gram)"


@query(_BASE + _RULES)
def rule_typos(spark, sf_dir):
    return g.rule_hits(typed_tokens(spark, sf_dir)).select(*g.KEYS, "hit", "suggestion", "description")


def _lost(spark, sf_dir):
    plain = en.sentences(synthetic_reports(spark, sf_dir)).withColumn("t", F.regexp_replace("sentence", "[^\\u4e00-\\u9fa5]", ""))
    return g.anomalies(typed_tokens(spark, sf_dir), corpus.ngram_counts(plain.where(F.length("t") >= 3), 3, 5, "t"))


@query(_BASE.rstrip() + f", {_KNOWN}, {_LOST} SELECT {_K}, CAST(position AS INTEGER) AS position, gram, context FROM an")
def unseen_ngrams(spark, sf_dir):
    return _lost(spark, sf_dir).withColumn("position", F.col("position").cast("int"))


_TERM = f"(context IN ({', '.join(o.quote(t) for t in extra.TERMS)}) OR regexp_matches(context, '.+({'|'.join(extra.TERMS)})$') OR " + " OR ".join(f"(contains(context, '{t}') AND length(context) < {len(t) + 3})" for t in extra.TERMS) + ")"


@query(_BASE.rstrip() + f""", {_KNOWN}, {_LOST}, ru AS ({_RULES})
SELECT {_K}, 'rule' AS source, hit AS text, suggestion FROM ru UNION ALL SELECT {_K}, 'ngram', gram, NULL FROM an WHERE NOT {_TERM} QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY position) <= 5""".replace("UNION ALL SELECT " + _K + ", 'ngram'", "UNION ALL SELECT * FROM (SELECT " + _K + ", 'ngram'").replace("<= 5", "<= 5)"))
def grammar_check(spark, sf_dir):
    """Rule hits, and of each sentence the first five unseen grams that aren't part of a known term."""
    from pyspark.sql import Window

    rules = g.rule_hits(typed_tokens(spark, sf_dir)).select(*g.KEYS, F.lit("rule").alias("source"), F.col("hit").alias("text"), "suggestion")
    w = Window.partitionBy(*g.KEYS).orderBy("position")
    lost = _lost(spark, sf_dir).where(~extra.is_term(F.col("context"))).withColumn("k", F.row_number().over(w)).where("k <= 5")
    return rules.unionByName(lost.select(*g.KEYS, F.lit("ngram").alias("source"), F.col("gram").alias("text"), F.lit(None).cast("string").alias("suggestion")))


_TURNS = r"""w AS MATERIALIZED (SELECT list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), lambda x: x <> '') AS t, count(*) AS times FROM conversations WHERE text IS NOT NULL GROUP BY 1),
c1 AS (SELECT t[i] AS a, t[i + d] AS b, times FROM (SELECT t, times, i, unnest(range(1, least(5, len(t) - i) + 1)) AS d FROM (SELECT t, times, unnest(range(1, len(t))) AS i FROM w WHERE len(t) > 1))),
cc AS MATERIALIZED (SELECT a, b, CAST(sum(times) AS DOUBLE) AS n FROM (SELECT a, b, times FROM c1 UNION ALL SELECT b, a, times FROM c1) GROUP BY 1, 2),
m AS MATERIALIZED (SELECT a, sum(n) AS na FROM cc GROUP BY 1)"""


@query(f"WITH {_TURNS} SELECT cc.a, cc.b, round(x, 6) AS x FROM (SELECT cc.a, cc.b, ln(n * (SELECT sum(na) FROM m) / (p.na * q.na)) AS x FROM cc JOIN m p ON p.a = cc.a JOIN m q ON q.a = cc.b) cc WHERE x > 1e-12")
def word_association(spark, sf_dir):
    """Which words of the conversations stand together more often than by chance."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z\\u00e0-\\u00ff]+"), F.lit(0))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL").select(words.alias("tokens"))
    return word_vectors.ppmi(word_vectors.cooccurrences(rows)).select("a", "b", F.round("x", 6).alias("x"))


def likeness(spark, sf_dir):
    """The measure of findings by word vectors, learnt from the clean sentences."""
    cost = word_costs(spark, sf_dir)
    found, _ = word_vectors.vectors(word_vectors.ppmi(word_vectors.cooccurrences(vocabulary.segmented(en.sentences(synthetic_reports(spark, sf_dir)), cost))))
    return word_vectors.Likeness(found, cost)


@query()
def vector_contradiction(spark, sf_dir):
    """Contradictions by the likeness of word vectors."""
    reports = synthetic_reports(spark, sf_dir)
    return checks.contradictions(stored(en.entities(reports)), likeness=likeness(spark, sf_dir))


@query()
def vector_orient_error(spark, sf_dir):
    """Swapped sides by the likeness of word vectors."""
    reports = synthetic_reports(spark, sf_dir)
    return checks.orient_errors(stored(en.entities(reports)), likeness=likeness(spark, sf_dir))
