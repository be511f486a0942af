"""Corpus statistics and lexicons: counts with partial aggregation, lexicons by equi-joins."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import all_of, count_of
from tessera.scratch import stored

WORD = "[A-Za-zÀ-ÿ\\u4e00-\\u9fff]+"


def words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, pos, word): runs of letters, lower-cased, with their place."""
    return docs.select(key, F.posexplode(all_of(F.lower(text), WORD)).alias("pos", "word"))


def word_freq(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, freq): hash aggregation with partial counts in each task."""
    return docs.select(F.explode(all_of(F.lower(text), WORD)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def corpus_totals(freq: DataFrame) -> DataFrame:
    return freq.agg(F.sum("freq").alias("total_words"), F.count("*").alias("unique_words"))


def substring_freq(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """(term, n): non-overlapping occurrences of each vocabulary term; the vocabulary is a small literal list."""
    n = lambda t: ((F.length(text) - F.length(F.replace(F.col(text), F.lit(t), F.lit("")))) / len(t)).cast("long")
    terms = F.array(*(F.struct(F.lit(t).alias("term"), n(t).alias("n")) for t in vocabulary))
    return docs.select(F.explode(terms).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n"))


def phrase_freq(docs: DataFrame, size: int = 2, text: str = "text") -> DataFrame:
    """(phrase, n): overlapping runs of ``size`` words of a document."""
    w = F.col("w")
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
    rows = docs.select(all_of(F.lower(text), WORD).alias("w")).where(F.size("w") >= size)
    return rows.select(F.explode(grams).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


#: Characters of a text that substrings are taken from at once: they are found from its start on.
PART = 200


def char_ngrams(rows: DataFrame, least: int, most: int, text: str = "sentence") -> DataFrame:
    """rows plus gram: all substrings of least..most characters. Long texts go in parts with what follows them, so time is in proportion."""
    t = F.col(text)
    cut = lambda k: F.regexp_extract_all(t, F.lit(f"(?s)(.{{1,{PART}}})(?=(.{{0,{most - 1}}}))"), F.lit(k))
    long = F.zip_with(cut(1), cut(2), lambda x, y: F.struct(x.alias("own"), F.concat(x, y).alias("all")))
    parts = F.when(F.length(t) > PART, long).otherwise(F.array(F.struct(t.alias("own"), t.alias("all"))))
    rows = rows.select("*", F.explode(parts).alias("part_"))
    own, whole = F.length("part_.own"), F.col("part_.all")
    of = lambda n: F.transform(F.sequence(F.lit(1), F.least(own, F.length(whole) - n + 1)), lambda i: F.substring(whole, i, n))
    grams = F.concat(*(F.when(F.length(whole) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in range(least, most + 1)))
    return rows.select("*", F.explode(grams).alias("gram")).drop("part_")


def ngram_counts(rows: DataFrame, n: int = 3, min_count: int = 5, text: str = "sentence") -> DataFrame:
    """(gram, n): character n-grams with at least min_count occurrences."""
    return char_ngrams(rows, n, n, text).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def char_topn(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(ch, n): the k most frequent letters and digits; ties by the character."""
    chars = docs.select(F.explode(all_of(F.col(text), "[A-Za-z0-9]")).alias("ch"))
    return chars.groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch").limit(k)


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return docs.select("doc_id", F.length(t).cast("long").alias("total_chars"), count_of(t, "[\\u4e00-\\u9fa5]").alias("chinese_chars"), count_of(t, "[a-zA-Z]").alias("english_chars"), count_of(t, "[0-9]").alias("digits"), count_of(t, "[ \\t\\n\\r]").alias("spaces"), count_of(t, "\\n").alias("line_breaks"))


def lexicon_summary(freq: DataFrame) -> DataFrame:
    """Count, mean, median, 90th percentile and share of repeated words."""
    f = F.col("freq").cast("double")
    return freq.agg(F.count("*").alias("n"), F.round(F.avg(f), 6).alias("mean_freq"), F.round(F.median(f), 6).alias("median_freq"), F.round(F.percentile(f, 0.9), 6).alias("p90_freq"), F.round(F.avg((f > 1).cast("double")), 6).alias("repeated_share"))


def confusion_pairs(freq: DataFrame, most_wrong: int = 2, least_right: int = 20) -> DataFrame:
    """(wrong, correct, w_freq, c_freq): rare words one letter away from a frequent word of the same length.

    Words meet on the pattern that is left when one position is blanked, so the join is
    on equality; no word is compared with all others.
    """
    blanks = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.overlay(w, F.lit("_"), i))
    long = freq.where(F.length("word") >= 4).select("word", "freq", F.explode(blanks(F.col("word"))).alias("blank"))
    wrong = long.where(F.col("freq") <= most_wrong).select(F.col("word").alias("wrong"), F.col("freq").alias("w_freq"), "blank")
    right = long.where(F.col("freq") >= least_right).select(F.col("word").alias("correct"), F.col("freq").alias("c_freq"), "blank")
    return wrong.join(right, "blank").where("wrong <> correct").select("wrong", "correct", "w_freq", "c_freq")


def offline_scores(pairs: DataFrame, k: int = 8) -> DataFrame:
    """pairs plus offline_score, the k best corrections of each wrong word."""
    scored = pairs.withColumn("offline_score", F.round(F.ln((F.col("c_freq") + 1) / (F.col("w_freq") + 1)), 6))
    w = Window.partitionBy("wrong").orderBy(F.desc("offline_score"), F.desc("c_freq"), "correct")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def high_risk_scores(general: DataFrame, special: DataFrame, least: float) -> DataFrame:
    """(word, general_freq, special_freq, score): words of general language that the special corpus hardly has."""
    g = general.select("word", F.col("freq").alias("general_freq"))
    s = special.select("word", F.col("freq").alias("special_freq"))
    both = g.join(s, "word", "left").withColumn("special_freq", F.coalesce("special_freq", F.lit(0)))
    score = F.round(F.ln(F.col("general_freq") + 1) / F.ln(F.col("special_freq") + 2), 6)
    return both.withColumn("score", score).where(F.col("score") > least)


#: Different pairs of words that a task holds before it passes on their numbers.
HELD = 200_000


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lo, hi, forward, backward): how often two different words of a document stand next to each other, either way round.

    A task counts the pairs of its texts and passes on sums; the two orders of a pair are one key.
    """
    word = re.compile(WORD)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()

        def out():
            rows = [(a, b, n, 0) if a < b else (b, a, 0, n) for (a, b), n in seen.items() if a != b]
            return pa.RecordBatch.from_pylist([dict(zip(("lo", "hi", "forward", "backward"), r, strict=True)) for r in rows], schema=kind)

        for batch in batches:
            for t in batch.column("t").to_pylist():
                w = word.findall(t or "")
                seen.update(zip(w, w[1:], strict=False))
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        yield out()

    kind = pa.schema([("lo", pa.string()), ("hi", pa.string()), ("forward", pa.int64()), ("backward", pa.int64())])
    part = docs.select(F.lower(text).alias("t")).mapInArrow(f, "lo string, hi string, forward long, backward long")
    return part.groupBy("lo", "hi").agg(F.sum("forward").alias("forward"), F.sum("backward").alias("backward"))


def order_templates(docs: DataFrame, least_ratio: float = 2.0, text: str = "text") -> DataFrame:
    """(correct, error, correct_freq, error_freq, ratio): word pairs that hardly ever occur the other way round."""
    way = lambda a, b, n, m: F.struct(F.concat_ws(" ", a, b).alias("correct"), F.concat_ws(" ", b, a).alias("error"), F.col(n).alias("correct_freq"), F.col(m).alias("error_freq"))
    both = pair_counts(docs, text).where("forward > 0 AND backward > 0")
    each = both.select(F.explode(F.array(way("lo", "hi", "forward", "backward"), way("hi", "lo", "backward", "forward"))).alias("x")).select("x.*")
    return each.withColumn("ratio", F.round(F.col("correct_freq") / (F.col("error_freq") + 1), 6)).where(F.col("ratio") >= least_ratio)


def typo_scan(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, pos, word, correct): words of a text that the confusion list knows, with the best correction."""
    best = pairs.groupBy("wrong").agg(F.max_by("correct", F.struct("c_freq", "correct")).alias("correct"))
    return words(docs).join(best, F.col("word") == F.col("wrong")).select("doc_id", "pos", "word", "correct")


def bigrams(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, pos, phrase): neighbouring words, made inside the row."""
    w = F.col("w")
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return docs.select(key, all_of(F.lower(text), WORD).alias("w")).where(F.size("w") >= 2).select(key, F.posexplode(pairs).alias("pos", "phrase"))


def order_detect(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, pos, phrase, correct): neighbouring words in an order that the templates call wrong."""
    held = stored(templates.select(F.col("error").alias("phrase"), "correct"))  # its size decides how the pairs meet it
    return bigrams(docs).join(held, "phrase").select("doc_id", "pos", "phrase", "correct")


def rule_typos(rows: DataFrame, rules: tuple[tuple[str, str], ...], text: str = "sentence") -> DataFrame:
    """rows plus (pattern, suggestion) for each rule that fits; rules are literals."""
    found = F.array_compact(F.array(*(F.when(F.contains(F.col(text), F.lit(p)), F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("suggestion"))) for p, s in rules)))
    return rows.select("*", F.explode(found).alias("r")).select(*rows.columns, "r.pattern", "r.suggestion")


def error_stats(errors: DataFrame) -> DataFrame:
    """(error_type, field, n) with subtotals by type, by field and in all."""
    both = F.grouping_id()
    return errors.cube("error_type", "field").agg(F.count("*").alias("n"), both.cast("int").alias("level"))


def parameter_grid(spark: SparkSession, pairs: DataFrame, least_right: list[int], most_wrong: list[int]) -> DataFrame:
    """(least_right, most_wrong, n_pairs, n_wrong): what is left of the pairs under each setting of a small grid."""
    grid = spark.createDataFrame([(a, b) for a in least_right for b in most_wrong], "least_right int, most_wrong int")
    joined = F.broadcast(grid).join(pairs, (F.col("c_freq") >= F.col("least_right")) & (F.col("w_freq") <= F.col("most_wrong")))
    return joined.groupBy("least_right", "most_wrong").agg(F.count("*").alias("n_pairs"), F.count_distinct("wrong").alias("n_wrong"))
