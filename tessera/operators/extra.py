"""Smaller operators: path handling, filters with fallback, neighbours, longest alternatives, verdicts, deductions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import LEXICON
from tessera.dictionaries import DEFAULT, Dictionaries
from tessera.functions.automaton import with_places
from tessera.operators.entities import on_path, opposite

#: Path depth by modality, and roots that keep one node more.
DEPTH = {"CT": 1, "MR": 1, "DX": 5, "MG": 5}
DEEPER = ("脊柱", "上肢", "下肢", "腹部", "颜面", "主动脉")
#: Syllables that sound alike, of our own small list.
HOMOPHONES = {"结": "节洁", "节": "结洁", "影": "应迎", "灶": "造燥", "积": "机极", "囊": "馕", "增": "曾赠", "侧": "测策", "纹": "文闻", "理": "里礼", "密": "蜜秘", "度": "渡肚"}
TERMS = ("炎", "症", "瘤", "结石", "囊肿", "增生", "积液")


def shortened(path: Column, modality: Column) -> Column:
    """The path's node at the depth that a modality reports."""
    nodes = F.split(path, ">")
    depth = reduce(lambda c, kv: c.when(modality == kv[0], kv[1]), DEPTH.items(), F.when(F.lit(False), 0)).otherwise(5)
    return F.element_at(nodes, F.least(depth + F.when(nodes[0].isin(*DEEPER), 1).otherwise(0), F.size(nodes)))


def is_term(phrase: Column) -> Column:
    """A phrase that is a known term, ends in one, or holds one and is hardly longer."""
    exact = phrase.isin(*TERMS)
    ends = phrase.rlike(f".+({'|'.join(TERMS)})$")
    holds = reduce(lambda a, b: a | b, (F.contains(phrase, F.lit(t)) & (F.length(phrase) < len(t) + 3) for t in TERMS))
    return exact | ends | holds


def first_of(ents: DataFrame, keys: list[str]) -> DataFrame:
    """ents without later rows of the same keys, in text order."""
    w = Window.partitionBy(*keys).orderBy("field", "sentence_index", "start", "match_no")
    return ents.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def neighbours(ents: DataFrame) -> DataFrame:
    """ents plus the end of the entity before and the start of the one after, in the sentence."""
    w = Window.partitionBy("report_id", "field", "sentence_index").orderBy("start", "match_no")
    return ents.withColumn("previous_end", F.lag("end").over(w)).withColumn("next_start", F.lead("start").over(w))


def name_places(rows: DataFrame, spark: SparkSession, text: str = "sentence", dicts: Dictionaries = DEFAULT) -> DataFrame:
    """rows plus (keyword, start, stop): every name that occurs, where it occurs first; all in one walk along each text."""
    return with_places(rows, dicts.names(), text, first_only=True).withColumnRenamed("term", "keyword")


def outermost(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans (…, start, stop) that lie strictly inside no other one of their key."""
    a, b = spans.alias("a"), spans.select(*keys, F.col("start").alias("s"), F.col("stop").alias("t")).alias("b")
    inside = (F.col("s") <= F.col("a.start")) & (F.col("t") >= F.col("a.stop")) & ((F.col("s") < F.col("a.start")) | (F.col("t") > F.col("a.stop")))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, reduce(lambda x, y: x & y, on) & inside, "left_anti")


def longest_names(rows: DataFrame, spark: SparkSession, text: str = "sentence") -> DataFrame:
    """rows plus (keyword, start): of all names that occur first at one place, the longest."""
    hit = name_places(rows, spark, text).drop("stop")
    w = Window.partitionBy(*rows.columns, "start")
    return hit.withColumn("most", F.max(F.length("keyword")).over(w)).where(F.length("keyword") == F.col("most")).drop("most")


def longest_axis(ents: DataFrame) -> DataFrame:
    """Of each sentence the entities with the longest range on the axis, ties kept."""
    w = Window.partitionBy("report_id", "field", "sentence_index")
    span = F.col("hi") - F.col("lo")
    return ents.withColumn("most", F.max(span).over(w)).where(span == F.col("most")).drop("most")


def mode_filtered(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, template, sex, want_sex) whose template suits the sex, or all of a key's rows if none does."""
    fits = (F.col("want_sex") == "") | (F.col("want_sex") == F.col("sex"))
    w = Window.partitionBy(key)
    return rows.withColumn("fits", fits).withColumn("any_fit", F.bool_or("fits").over(w)).where("fits OR NOT any_fit").drop("fits", "any_fit")


def history_matches(ents: DataFrame) -> DataFrame:
    """(patient, report_id, other_id, position): positive entities of a patient's other reports on the same part and no opposite side."""
    d = ents.where("field = 'description'")
    a = d.select("patient", "report_id", "position", "orientation").distinct()
    b = d.where("positive >= 2").select("patient", F.col("report_id").alias("other_id"), F.col("path").alias("b_path"), F.col("orientation").alias("b_side")).distinct()
    return a.join(b, "patient").where((F.col("report_id") > F.col("other_id")) & on_path(F.col("b_path"), F.col("position")) & ~opposite(F.col("orientation"), F.col("b_side"))).select("patient", "report_id", "other_id", "position").distinct()


def judged(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(finding_id, text): kept findings; weak ones and those to be reviewed are marked."""
    j = findings.join(F.broadcast(verdicts), findings["finding_id"] == verdicts["candidate_id"])
    text = F.when(F.col("action") == "weak", F.concat(F.lit("[弱阳性]"), "finding")).when(F.col("action") == "needs_review", F.concat(F.lit("[待审核]"), "finding")).otherwise(F.col("finding"))
    return j.where("action <> 'drop'").select("finding_id", text.alias("text"))


def homophone_pairs(freq: DataFrame, spark: SparkSession, least_right: int = 100) -> DataFrame:
    """(wrong, correct, c_freq): rare or unseen words made from a frequent one by one sound-alike character."""
    table = spark.createDataFrame([(c, h) for c, hs in HOMOPHONES.items() for h in hs], "ch string, other string")
    right = freq.where((F.col("freq") >= least_right) & (F.length("word") >= 2)).select(F.col("word").alias("correct"), F.col("freq").alias("c_freq"))
    at = right.select("*", F.posexplode(F.split("correct", "")).alias("i", "ch"))
    made = at.join(F.broadcast(table), "ch").select(F.overlay("correct", F.col("other"), F.col("i") + 1).alias("wrong"), "correct", "c_freq")
    seen = freq.where(F.col("freq") >= least_right).select(F.col("word").alias("wrong"))
    return made.join(seen, "wrong", "left_anti").distinct()


def kept_highlights(marks: DataFrame, key: str) -> DataFrame:
    """marks (key, start, end, priority) that overlap no mark of a lower priority number at the time; an ordered fold for each key."""
    item = F.struct("start", "priority", "end")
    groups = marks.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        clash = F.coalesce(x["start"] < last["end"], F.lit(False))
        swap = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(x))
        return F.when(~clash, F.concat(acc, F.array(x))).when(x["priority"] < last["priority"], swap).otherwise(acc)

    kind = marks.select(F.array(item)).schema[0].dataType.simpleString()
    kept = F.aggregate("xs", F.array().cast(kind), step)
    return groups.select(key, F.explode(kept).alias("m")).select(key, "m.start", "m.end", "m.priority")


def ignored(ents: DataFrame) -> DataFrame:
    return ents.withColumn("ignore", F.col("sentence").rlike(f"(?i){LEXICON.ignore_sentence}"))
