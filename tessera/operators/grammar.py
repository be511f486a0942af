"""Wrong words and word order: scans against lexicons, mining of the lexicons, and what the language model says of a place.

A sentence keeps its tokens as an array, and windows of tokens are made from that array
inside the row, so nothing is shuffled until windows meet a lexicon on equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.dictionaries import DEFAULT
from tessera.operators import language_model
from tessera.operators.corpus import char_ngrams
from tessera.operators.extra import HOMOPHONES
from tessera.scratch import stored

KEYS = ["report_id", "field", "sentence_index"]
#: Limits of the windows, and the least differences and scores that count.
ORDER_TOKENS, ORDER_CHARS, RISK_TOKENS, RISK_CHARS, RUN_CHARS = 6, 6, 3, 10, 4
REJECT, ACCEPT, RISK_SCORE, ORDER_RATIO = -0.20, 0.15, 6.0, 150.0
_CJK = "^[\\u4e00-\\u9fff]+$"
#: What ends a short clause.
CLAUSE_MARKS = "。！？；，、：:;,.!?\\n\\r"


def vocabulary(words: tuple[str, ...] = fx.WORDS, names: tuple[str, ...] | None = None) -> list[str]:
    """Words of the segmenter, the longest first: its own, and names of body parts."""
    return sorted({*words, *(DEFAULT.names() if names is None else names)}, key=lambda w: (-len(w), w))


def pieces(rows: DataFrame, most_tokens: int) -> DataFrame:
    """rows plus (first, n, piece, start, before, after): all windows of up to ``most_tokens`` tokens, with their neighbours."""
    t, size = F.col("tokens"), F.size("tokens")
    window = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_tokens), size - i + 1)), lambda n: F.struct(i.alias("first"), n.alias("n")))
    every = F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(1), size), window)))
    at = rows.select("*", F.explode(every).alias("w")).select("*", "w.first", "w.n").drop("w")
    join = lambda a, n: F.array_join(F.slice(t, a, n), "")
    pick = lambda i: F.coalesce(F.get(t, i), F.lit(""))
    start = F.when(F.col("first") > 1, F.length(join(F.lit(1), F.col("first") - 1))).otherwise(0)
    return at.select("*", join(F.col("first"), F.col("n")).alias("piece"), start.alias("start"), F.when(F.col("first") > 1, pick(F.col("first") - 2)).otherwise("").alias("before"), pick(F.col("first") + F.col("n") - 1).alias("after"))


def token_freq(rows: DataFrame) -> DataFrame:
    """(word, freq) of the tokens that are all ideographs; rows with a column ``times`` count as often."""
    return rows.select(F.explode("tokens").alias("word"), times_of(rows)).where(F.col("word").rlike(_CJK)).groupBy("word").agg(F.sum("times").alias("freq"))


def times_of(rows: DataFrame) -> Column:
    return F.col("times") if "times" in rows.columns else F.lit(1).cast("long").alias("times")


def different(rows: DataFrame) -> DataFrame:
    """(sentence, times): the different sentences of rows."""
    return rows.groupBy("sentence").agg(F.count("*").alias("times"))


def of_all(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What was found in different sentences, keyed by any of their rows, for all rows (keys, sentence)."""
    return rows.select(*KEYS, "sentence").join(stored(found.drop(*KEYS)), "sentence")


def first_rows(rows: DataFrame) -> DataFrame:
    """(keys, sentence, tokens): one row for each different sentence."""
    return rows.groupBy("sentence").agg(F.min(F.struct(*KEYS)).alias("at"), F.min("tokens").alias("tokens")).select("at.*", "sentence", "tokens")


def run_counts(rows: DataFrame, least: int, most: int, text: str = "sentence") -> DataFrame:
    """(gram, n): how often each run of least..most characters occurs; equal sentences are cut up once."""
    each = rows.select(text, times_of(rows)).groupBy(text).agg(F.sum("times").alias("times"))
    return char_ngrams(each, least, most, text).groupBy("gram").agg(F.sum("times").alias("n"))


# --- lexicons --------------------------------------------------------------------------


def own_homophones(spark) -> DataFrame:
    return spark.createDataFrame([(c, h) for c, hs in HOMOPHONES.items() for h in hs], "ch string, other string")


def syllables(text: Column, table: dict[str, str] = HOMOPHONES) -> Column:
    """Every character as the first of those that sound like it."""
    head: dict[str, str] = {}
    for c, hs in table.items():
        for x in (c, *hs):
            head.setdefault(x, head.get(c, c))
    return F.translate(text, "".join(head), "".join(head.values()))


def variants(words: DataFrame, most: int = 200, apart: int = 3, homophones: DataFrame | None = None) -> DataFrame:
    """(word, variant): one character replaced by a homophone, or two that are at most ``apart`` places apart.

    Of two replacements the first ``most`` of a word, in order of places and characters. homophones: (char, homophone), else
    those of the package.
    """
    table = own_homophones(words.sparkSession) if homophones is None else homophones.select(F.col("char").alias("ch"), F.col("homophone").alias("other"))
    at = words.select("word", F.posexplode(F.split("word", "")).alias("i", "ch")).join(table, "ch").select("word", "i", "other")
    single = at.select("word", F.overlay("word", F.col("other"), F.col("i") + 1).alias("variant"))
    b = at.select("word", F.col("i").alias("j"), F.col("other").alias("other2"))
    pair = at.join(b, "word").where(f"i < j AND j - i <= {apart}")
    w = Window.partitionBy("word").orderBy("i", "j", "other", "other2")
    pair = pair.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    double = pair.select("word", F.overlay(F.overlay("word", F.col("other"), F.col("i") + 1), F.col("other2"), F.col("j") + 1).alias("variant"))
    return single.unionByName(double).where("variant <> word").distinct()


def confusions(freq: DataFrame, raw: DataFrame, least_right: int, most_wrong: int = 50, distance: int = 2, homophones: DataFrame | None = None) -> DataFrame:
    """(wrong, correct, w_freq, c_freq, raw_freq): variants of frequent words that are rare but do occur and sound alike.

    raw: sentences in which a variant must occur, if it isn't a word itself. homophones: a read table (char, homophone), whose
    variants sound alike by what they are made of; ``sounds`` finds pairs by syllables instead.
    """
    right = freq.where((F.col("freq") >= least_right) & F.length("word").between(2, 8)).select("word", F.col("freq").alias("c_freq"))
    made = variants(right.select("word"), homophones=homophones).join(right, "word").select(F.col("variant").alias("wrong"), F.col("word").alias("correct"), "c_freq")
    made = made.join(freq.select(F.col("word").alias("wrong"), F.col("freq").alias("w_freq")), "wrong", "left").withColumn("w_freq", F.coalesce("w_freq", F.lit(0).cast("long")))
    close = F.lit(True) if homophones is not None else F.levenshtein(syllables(F.col("wrong")), syllables(F.col("correct"))) <= distance
    made = made.where((F.col("w_freq") <= most_wrong) & close)
    seen = run_counts(raw, 2, 8).select(F.col("gram").alias("wrong"), F.col("n").alias("raw_freq"))
    return made.join(seen, "wrong", "left").withColumn("raw_freq", F.coalesce("raw_freq", F.lit(0).cast("long"))).where("NOT (w_freq = 0 AND raw_freq < 1)").select("wrong", "correct", "w_freq", "c_freq", "raw_freq")


def best_corrections(pairs: DataFrame) -> DataFrame:
    """(wrong, correct): the most frequent correction of each wrong word."""
    return pairs.groupBy("wrong").agg(F.max_by("correct", F.struct("c_freq", "correct")).alias("correct"))


def high_risk(freq: DataFrame, general: tuple = fx.GENERAL, least: float = 2.0) -> DataFrame:
    """(word, score): words of general language that the corpus hardly has."""
    g = freq.sparkSession.createDataFrame(list(general), "word string, general long, pos string")
    score = F.round(F.ln(F.col("general") + 1) / F.ln(F.coalesce("freq", F.lit(0)) + 2), 6)
    return g.join(freq, "word", "left").select("word", score.alias("score")).where(F.col("score") > least)


def order_patterns(freq: DataFrame, raw: DataFrame, least: int, most_wrong: int = 20, ratio: float = 100.0, most_raw: int = 50, raw_ratio: float = 5.0) -> DataFrame:
    """(correct, error, part1, part2, correct_freq, error_freq, ratio, raw_correct, raw_error): words of two halves that hardly occur the other way round.

    Four-letter words, by the words of the corpus; then by how often both occur in the sentences.
    """
    words = freq.where((F.length("word") == 4) & (F.col("freq") >= least)).select(F.col("word").alias("correct"), F.col("freq").alias("correct_freq"))
    words = words.select("*", F.substring("correct", 1, 2).alias("part1"), F.substring("correct", 3, 2).alias("part2")).withColumn("error", F.concat("part2", "part1")).where("error <> correct")
    words = words.join(freq.select(F.col("word").alias("error"), F.col("freq").alias("error_freq")), "error", "left").withColumn("error_freq", F.coalesce("error_freq", F.lit(0).cast("long")))
    words = words.withColumn("ratio", F.round(F.col("correct_freq") / (F.col("error_freq") + 1), 6)).where((F.col("error_freq") <= most_wrong) & (F.col("ratio") >= ratio))
    seen = run_counts(raw, 4, 4).select("gram", F.col("n").alias("k"))
    for side in ("correct", "error"):
        words = words.join(seen.select(F.col("gram").alias(side), F.col("k").alias(f"raw_{side}")), side, "left").withColumn(f"raw_{side}", F.coalesce(f"raw_{side}", F.lit(0).cast("long")))
    keep = (F.col("raw_error") <= most_raw) & (F.col("raw_correct") / (F.col("raw_error") + 1) >= raw_ratio)
    return words.where(keep).select("correct", "error", "part1", "part2", "correct_freq", "error_freq", "ratio", "raw_correct", "raw_error")


def bigram_templates(freq: DataFrame, least: int, most_wrong: int = 20) -> DataFrame:
    """(first, second, forward, backward): pairs of characters that are a frequent word, but hardly one the other way round."""
    pairs = char_ngrams(freq.where((F.length("word").between(2, 6)) & (F.col("freq") >= least)).select("word"), 2, 2, "word").select(F.col("gram").alias("word")).distinct()
    found = pairs.join(freq, "word").where(F.col("freq") >= least).withColumn("back", F.reverse("word"))
    found = found.join(freq.select(F.col("word").alias("back"), F.col("freq").alias("backward")), "back", "left").withColumn("backward", F.coalesce("backward", F.lit(0).cast("long")))
    return found.where(F.col("backward") <= most_wrong).select(F.substring("word", 1, 1).alias("first"), F.substring("word", 2, 1).alias("second"), F.col("freq").alias("forward"), "backward")


def substitutions(pairs: DataFrame) -> DataFrame:
    """(ch, other): single characters that a confusion pair of equal length swaps, and no other."""
    same = pairs.where("length(wrong) = length(correct)").select("wrong", "correct", F.explode(F.sequence(F.lit(1), F.length("wrong"))).alias("i"))
    differ = same.select("wrong", "correct", F.substring("wrong", F.col("i"), F.lit(1)).alias("ch"), F.substring("correct", F.col("i"), F.lit(1)).alias("other")).where("ch <> other")
    one = differ.groupBy("wrong", "correct").agg(F.count("*").alias("n"), F.min("ch").alias("ch"), F.min("other").alias("other")).where("n = 1")
    return one.select("ch", "other").distinct()


# --- language model ------------------------------------------------------------------------


def deltas(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """asked (…, before, error, suggestion, after) plus delta: by how much the suggestion scores better in its context."""
    pair = lambda c: F.concat("before", c, "after")
    rows = asked.withColumn("old", pair("error")).withColumn("new", pair("suggestion"))
    texts = rows.select(F.explode(F.array("old", "new")).alias("text")).distinct()
    scores = language_model.scores(texts, grams)
    named = lambda c: scores.select(F.col("text").alias(c), F.col("lm").alias(f"{c}_lm"))
    return rows.join(named("old"), "old").join(named("new"), "new").withColumn("delta", F.round(F.col("new_lm") - F.col("old_lm"), 6)).drop("old", "new", "old_lm", "new_lm")


# --- detection ----------------------------------------------------------------------------


def scan(rows: DataFrame, pairs: DataFrame, risk: DataFrame) -> DataFrame:
    """(keys, sentence, start, stop, error, suggestion, kind, score, before, after): what the lexicons know of a sentence's tokens.

    Whole tokens, compounds of a risky name and an ending, runs of single characters (the shortest that is known), and
    windows of several tokens. A span counts once, in that order. rows: of ``segmented``; pairs: (wrong, correct).
    """
    base = pieces(rows, max(RISK_TOKENS, RUN_CHARS)).select(*KEYS, "sentence", "first", "n", "piece", "start", "before", "after")
    typo = pairs.select(F.col("wrong").alias("piece"), F.col("correct").alias("suggestion"))
    danger = risk.select(F.col("word").alias("piece"), "score")
    none, no_score = F.lit(None).cast("string"), F.lit(None).cast("double")
    hits = lambda df, kind, rank: df.select(*KEYS, "sentence", "first", "n", "piece", "start", "before", "after", "suggestion", "score", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
    # one pass over all windows leaves the few that a lexicon holds
    held = stored(base.join(typo, "piece", "left").join(danger, "piece", "left").where("suggestion IS NOT NULL OR score IS NOT NULL"))
    known = held.where("suggestion IS NOT NULL").withColumn("score", no_score)
    risky = held.where("score IS NOT NULL").withColumn("suggestion", none)
    ends = base.where("n = 1 AND length(piece) >= 4").select("*", F.explode(F.array(*map(F.lit, fx.SUFFIXES))).alias("suffix")).where(F.endswith("piece", F.col("suffix")))
    ends = ends.withColumn("name", F.substring("piece", F.lit(1), F.length("piece") - F.length("suffix"))).where("length(name) >= 3")
    compound = ends.join(danger.withColumnRenamed("piece", "name"), "name").withColumn("suggestion", none)
    run = (F.col("n") >= 2) & (F.col("n") <= RUN_CHARS) & (F.length("piece") == F.col("n")) & ~F.col("piece").rlike(f"[{fx.BLOCKED}]")
    runs = hits(known.where(run), "typo", 4).unionByName(hits(risky.where(run), "general_high_risk", 5))
    w = Window.partitionBy(*KEYS, "first").orderBy("n", "rank")
    runs = runs.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    several = hits(risky.where((F.col("n") >= 2) & (F.col("n") <= RISK_TOKENS) & (F.length("piece") <= RISK_CHARS)), "general_high_risk", 6)
    every = reduce(DataFrame.unionByName, [hits(known.where("n = 1"), "typo", 1), hits(risky.where("n = 1"), "general_high_risk", 2), hits(compound, "general_high_risk", 3), runs, several])
    w = Window.partitionBy(*KEYS, "start", "piece").orderBy("rank")
    every = every.withColumn("k", F.row_number().over(w)).where("k = 1")
    stop = (F.col("start") + F.length("piece")).alias("stop")
    return every.select(*KEYS, "sentence", "start", stop, F.col("piece").alias("error"), "suggestion", "kind", "score", "before", "after")


def plausible(found: DataFrame, grams: DataFrame, reject: float = REJECT) -> DataFrame:
    """found without typos whose suggestion scores clearly worse in their context; without neighbours all stay."""
    alone = found.where("suggestion IS NULL OR (before = '' AND after = '')")
    asked = found.where("suggestion IS NOT NULL AND NOT (before = '' AND after = '')")
    return alone.unionByName(deltas(asked, grams).where(F.col("delta") > reject).drop("delta"))


def expanded(rows: DataFrame, taken: DataFrame, swaps: DataFrame, freq: DataFrame, grams: DataFrame, least: int, accept: float = ACCEPT) -> DataFrame:
    """(keys, sentence, start, stop, error, suggestion, delta): tokens of which a neighbour word scores clearly better in context.

    Candidates swap one character (``swaps``) and are frequent words. Spans that ``taken`` holds are left out.
    """
    base = pieces(rows, 1).where(F.col("piece").rlike(_CJK) & F.length("piece").between(2, 8) & ((F.col("before") != "") | (F.col("after") != "")))
    base = base.select(*KEYS, "sentence", "start", F.col("piece").alias("error"), "before", "after").withColumn("stop", F.col("start") + F.length("error"))
    base = base.join(taken.select(*KEYS, "start", "stop"), [*KEYS, "start", "stop"], "left_anti")
    at = base.select("*", F.posexplode(F.split("error", "")).alias("i", "ch")).join(swaps, "ch")
    made = at.withColumn("suggestion", F.overlay("error", F.col("other"), F.col("i") + 1)).join(freq.where(F.col("freq") >= least).select(F.col("word").alias("suggestion")), "suggestion", "left_semi")
    made = made.select(*KEYS, "sentence", "start", "stop", "error", "before", "after", "suggestion").distinct()
    scored = deltas(made, grams).where(F.col("delta") >= accept)
    w = Window.partitionBy(*KEYS, "start", "stop").orderBy(F.desc("delta"), "suggestion")
    return scored.withColumn("k", F.row_number().over(w)).where("k = 1").select(*KEYS, "sentence", "start", "stop", "error", "suggestion", "delta")


def wrong_order(rows: DataFrame, patterns: DataFrame, freq: DataFrame, least_chunk: int = 5) -> DataFrame:
    """(keys, sentence, start, stop, error, suggestion, ratio): windows that are a pattern's error.

    The tokens must part where the pattern's halves meet, or be one token of which a half is a frequent word; the
    sentence must not hold the right order.
    """
    base = pieces(rows, ORDER_TOKENS).where(F.length("piece") <= ORDER_CHARS)
    hit = base.join(patterns.select(F.col("error").alias("piece"), "correct", "part1", "part2", "ratio"), "piece").where(~F.contains("sentence", F.col("correct")))
    inner = F.slice("tokens", F.col("first"), F.col("n"))
    parts = F.exists(F.sequence(F.lit(1), F.col("n")), lambda k: F.array_join(F.slice(inner, F.lit(1), k), "") == F.col("part2"))
    f = lambda c: freq.select(F.col("word").alias(c), F.col("freq").alias(f"{c}_freq"))
    hit = hit.join(f("part1"), "part1", "left").join(f("part2"), "part2", "left")
    stable = F.greatest(F.coalesce("part1_freq", F.lit(0)), F.coalesce("part2_freq", F.lit(0))) >= least_chunk
    ok = hit.where(parts | ((F.col("n") == 1) & stable))
    return ok.select(*KEYS, "sentence", "start", (F.col("start") + F.length("piece")).alias("stop"), F.col("piece").alias("error"), F.col("correct").alias("suggestion"), "ratio").distinct()


def context(sentence: Column, start: Column, stop: Column) -> Column:
    """The short clause around a span."""
    left = F.regexp_extract(F.substring(sentence, F.lit(1), start), f"[^{CLAUSE_MARKS}]*$", 0)
    right = F.regexp_extract(F.substring(sentence, stop + 1, F.length(sentence)), f"^[^{CLAUSE_MARKS}]*", 0)
    return F.concat(left, F.substring(sentence, start + 1, stop - start), right)


def enough_context(clause: Column, error: Column) -> Column:
    """Whether a clause says more than the error, by two letters at least."""
    bare = lambda c: F.length(F.regexp_replace(c, "\\s+", ""))
    return bare(clause) >= bare(error) + 2


def detect(rows: DataFrame, pairs: DataFrame, risk: DataFrame, patterns: DataFrame, freq: DataFrame, grams: DataFrame, least: int) -> DataFrame:
    """(keys, start, stop, error, suggestion, error_type, context, score, rule_source): all errors of segmented sentences, a span once."""
    no_latin = ~F.col("error").rlike("[0-9A-Za-z]") & ~F.coalesce("suggestion", F.lit("")).rlike("[0-9A-Za-z]")
    # what a sentence holds doesn't depend on its report: each is looked at once
    every_row, rows = rows.select(*KEYS, "sentence"), stored(first_rows(rows))
    found = scan(rows, best_corrections(pairs), risk).where(no_latin).where((F.col("kind") == "typo") | (F.col("score") >= RISK_SCORE))
    direct = stored(plausible(found, grams))
    more = expanded(rows, direct, substitutions(pairs), freq, grams, least)
    order = wrong_order(rows, patterns, freq).where(enough_context(context(F.col("sentence"), F.col("start"), F.col("stop")), F.col("error")) & (F.col("ratio") >= ORDER_RATIO))
    row = lambda df, kind, score, source, rank: df.select(*KEYS, "sentence", "start", "stop", "error", "suggestion", kind.alias("error_type"), score.cast("double").alias("score"), source.alias("rule_source"), F.lit(rank).alias("rank"))
    source = F.when(F.col("kind") == "typo", "direct_confusion").otherwise("high_risk_lexicon")
    every = row(direct, F.col("kind"), F.col("score"), source, 1).unionByName(row(more, F.lit("typo"), F.col("delta"), F.lit("expanded_candidate"), 2)).unionByName(row(order, F.lit("word_order"), F.col("ratio"), F.lit("word_order_template"), 3))
    w = Window.partitionBy(*KEYS, "start", "stop").orderBy("rank", "error_type")
    every = every.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "rank", *KEYS)
    every = every_row.join(stored(every), "sentence")
    return every.select(*KEYS, "start", "stop", "error", "suggestion", "error_type", context(F.col("sentence"), F.col("start"), F.col("stop")).alias("context"), "score", "rule_source")


def corrected(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(keys, corrected): sentences with their suggestions put in, from the right to the left; overlapping spans give way to the one on the right."""
    item = F.struct((-F.col("start")).alias("order"), "start", "stop", "suggestion")
    spans = found.where("suggestion IS NOT NULL").groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    base = rows.select(*KEYS, "sentence").join(spans, KEYS)
    zero = F.struct(F.col("sentence").alias("t"), F.length("sentence").alias("edge"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(F.substring(acc["t"], F.lit(1), x["start"]), x["suggestion"], F.substring(acc["t"], x["stop"] + 1, F.length(acc["t"])))
        return F.when(x["stop"] <= acc["edge"], F.struct(new.alias("t"), x["start"].alias("edge"))).otherwise(acc)

    return base.select(*KEYS, F.aggregate("xs", zero, step)["t"].alias("corrected"))


def rule_hits(rows: DataFrame, rules: tuple = fx.TYPO_RULES, text: str = "sentence") -> DataFrame:
    """rows plus (hit, suggestion, description): every place that a pattern of wrong wording fits."""
    def hits(pattern: str, suggestion: str, description: str) -> Column:
        of = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(of, lambda x: F.struct(x.alias("hit"), F.lit(suggestion).alias("suggestion"), F.lit(description).alias("description")))

    found = F.concat(*(hits(*r) for r in rules))
    return rows.select("*", F.explode(found).alias("r")).select(*rows.columns, "r.hit", "r.suggestion", "r.description")


def anomalies(rows: DataFrame, known: DataFrame, n: int = 3, around: int = 3, text: str = "sentence") -> DataFrame:
    """(keys, position, gram, context): runs of ideographs that the table (gram, n) lacks, with what stands around them."""
    plain = rows.select(*KEYS, F.regexp_replace(text, "[^\\u4e00-\\u9fa5]", "").alias("t")).where(F.length("t") >= n)
    at = plain.select("*", F.explode(F.sequence(F.lit(1), F.length("t") - n + 1)).alias("i")).withColumn("gram", F.substring("t", F.col("i"), F.lit(n)))
    lost = at.join(known.select("gram"), "gram", "left_anti")
    first = F.greatest(F.lit(1), F.col("i") - around)
    return lost.select(*KEYS, (F.col("i") - 1).alias("position"), "gram", F.substring("t", first, F.col("i") + n + around - first).alias("context"))


# --- learnt tables ----------------------------------------------------------------------------

LEARNT = ("freq", "pairs", "risk", "patterns", "grams")


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Learnt tables as Parquet, one folder each: word frequencies, confusion pairs, risky words, order patterns, the language model."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark, path: str, names: tuple[str, ...] = LEARNT) -> dict[str, DataFrame]:
    """What ``save`` wrote."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
