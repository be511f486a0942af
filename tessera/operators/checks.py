"""Report checks: per-report rules, and relations between the entities of a report.

Relational checks join on ``report_id`` first, with path, side and polarity as residual
conditions, so they plan as hash or sort-merge joins and a report's entities meet in one
partition whatever their number elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from re import _parser as re_parser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import COMPLEXITY, LEXICON, Lexicon
from tessera.dictionaries import DEFAULT, Dictionaries
from tessera.functions.automaton import MOST, with_places
from tessera.functions.text import all_of, bigram_similarity
from tessera.operators.alike import counted, once
from tessera.operators.entities import entities, on_path, opposite, related
from tessera.scratch import stored



def modality(raw: Column) -> Column:
    """DX, CR, DR, XA, RF to DR; MR, NM to MR; CT and Hologic to CT; everything else to CT. The order matters."""
    up = F.upper(raw)
    first = F.when(up.isin("DX", "CR", "XA") | F.contains(up, F.lit("DR")) | F.contains(up, F.lit("RF")), "DR").otherwise(raw)
    second = F.when(F.upper(first).rlike("MR|NM"), "MR").otherwise(first)
    third = F.when(F.upper(second).rlike("CT|HOLOGIC"), "CT").otherwise(second)
    return F.when(third.isin("DR", "MR", "CT", "MG"), third).otherwise("CT")


def other_sex(text: Column, lexicon: Lexicon = LEXICON) -> Column:
    """Whether a text of a row with the column Sex holds words of the other sex."""
    return (F.col("Sex").isin("男", "M") & text.rlike(lexicon.female)) | (F.col("Sex").isin("女", "F") & text.rlike(lexicon.male))


def sex_conflicts(reports: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(report_id, sex_error): words of the other sex, each once, in alphabetical order."""
    text = F.concat("ReportStr", "ConclusionStr")
    words = lambda p: F.array_join(F.array_sort(F.array_distinct(all_of(text, p))), "；")
    error = F.when(F.col("Sex").isin("男", "M") & text.rlike(lexicon.female), F.concat(F.lit("男性报告中出现："), words(lexicon.female)))
    error = error.when(F.col("Sex").isin("女", "F") & text.rlike(lexicon.male), F.concat(F.lit("女性报告中出现："), words(lexicon.male)))
    return reports.select("report_id", error.alias("sex_error")).where("sex_error IS NOT NULL")


def rads_missing(reports: DataFrame) -> DataFrame:
    m, part, text = F.col("modality"), F.col("StudyPart"), F.col("ConclusionStr")
    breast = m.isin("MG", "DR", "DX", "MR") & F.contains(part, F.lit("乳腺")) & ~text.rlike("(?is)BI.*RADS")
    prostate = (m == "MR") & F.contains(part, F.lit("前列腺")) & ~text.rlike("(?is)PI.*RADS")
    return reports.select("report_id", F.when(breast, "缺少BI-RADS分类").when(prostate, "缺少PI-RADS分类").alias("rads")).where("rads IS NOT NULL")


def special_missing(reports: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(report_id, missing): one row for each special technique ordered but not described, or the reverse."""
    m, part, text = F.col("modality"), F.col("StudyPart"), F.col("ReportStr")
    both = F.concat("ReportStr", "ConclusionStr")
    lost = lambda p, label, mods: F.when(part.rlike(p) & ~text.rlike(p) & m.isin(*mods), label)
    sent = F.filter(F.split(both, lexicon.sentence_end), lambda s: s.rlike(lexicon.enhance_text) & ~s.rlike(lexicon.enhance_excuse))
    unordered = F.when((F.size(sent) > 0) & ~part.rlike(lexicon.enhance_order) & m.isin("CT", "MR"), "出现增强描述")
    described = text.rlike(f"{lexicon.enhance_text}|{lexicon.perfusion}")
    few = F.regexp_count(both, F.lit("动脉")) < 4
    absent = part.rlike(lexicon.enhance_order) & ~described & few & (((m == "CT") & (F.regexp_count(both, F.lit("静脉")) < 2)) | ((m == "MR") & ~F.contains(part, F.lit("平扫"))))
    found = F.array(unordered, F.when(absent, "增强未描述"), lost(lexicon.diffusion, "弥散成像未描述", ("MR",)), lost(lexicon.susceptibility, "磁敏感成像未描述", ("MR",)), lost(lexicon.perfusion, "灌注成像未描述", ("MR", "CT")), lost(lexicon.spectroscopy, "波谱成像未描述", ("MR",)))
    return reports.where(m.rlike(lexicon.check_modality)).select("report_id", F.explode(F.array_compact(found)).alias("missing"))


def nonstandard_terms(reports: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(report_id, term): unwanted terms, and terms of another modality."""
    text, m = F.concat("ReportStr", "ConclusionStr"), F.col("modality")
    own = F.when(m == "CT", all_of(text, lexicon.nonstandard_ct)).when(m == "MR", all_of(text, lexicon.nonstandard_mr)).otherwise(F.array().cast("array<string>"))
    return reports.select("report_id", F.explode(F.array_distinct(F.concat(all_of(text, lexicon.nonstandard), own))).alias("term"))


#: Wording of whole legs, whose lengths have no limit.
LEGS = "下肢长度|下肢全长|下肢长约|下肢力线"


def long_measures(text: Column, lexicon: Lexicon = LEXICON) -> Column:
    """Lengths of a text beyond the limit of their unit, each once; a factor takes the unit of the next length.

    Centimetres and millimetres of whole legs, and those that a 2, 3 or 0 follows (squares, cubes, cut numbers), are left out.
    """
    text = F.regexp_replace(F.replace(text, F.lit("*"), F.lit("×")), "(?i)[0-9]+([.][0-9]+)?ml", "")
    end = "(?i)(mm|cm|毫米|厘米|米|m)[230]?$"

    def beyond(run: Column) -> Column:
        unit = F.lower(F.regexp_extract(run, end, 1))
        limit = F.when(unit.isin("cm", "厘米"), lexicon.cm_max).when(unit.isin("mm", "毫米"), lexicon.mm_max).otherwise(lexicon.m_max)
        spared = (text.rlike(LEGS) | run.rlike("[230]$")) & unit.isin("cm", "厘米", "mm", "毫米")
        numbers = all_of(F.regexp_replace(run, end, ""), "[0-9]+(?:[.][0-9]+)?")
        return F.transform(F.filter(numbers, lambda n: (n.cast("double") > limit) & ~spared), lambda n: F.concat(n, unit))

    runs = all_of(text, "(?i)(?:[0-9]+(?:[.][0-9]+)?×)*[0-9]+(?:[.][0-9]+)?(?:mm|cm|毫米|厘米|米|m)[230]?")
    return F.array_distinct(F.flatten(F.transform(runs, beyond)))


def measure_errors(reports: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(report_id, measure_text): lengths beyond the limit of their unit, see ``long_measures``."""
    return reports.select("report_id", F.explode(long_measures(F.concat("ReportStr", "ConclusionStr"), lexicon)).alias("measure_text")).distinct()


def exam_parts(reports: DataFrame, dicts: Dictionaries = DEFAULT, ents: DataFrame | None = None) -> DataFrame:
    """(report_id, exam, exam_path, exam_side, StudyPart): the entities that an order's wording names. ents: rows of field ``title``, if there are."""
    e = entities(reports, ("title",), dicts) if ents is None else ents.where("field = 'title'")
    e = e.select("report_id", F.col("position").alias("exam"), F.col("path").alias("exam_path"), F.col("orientation").alias("exam_side"))
    return e.join(reports.select("report_id", "StudyPart"), "report_id")


def _same_part(e: DataFrame) -> Column:
    return related(F.col("exam_path"), F.col("path"))


def part_missing(reports: DataFrame, ents: DataFrame, dicts: Dictionaries = DEFAULT, exams: DataFrame | None = None) -> DataFrame:
    """(report_id, exam): exam parts without a compatible entity in the description; operations are skipped."""
    exams = (exam_parts(reports, dicts) if exams is None else exams).where(~F.col("StudyPart").rlike(dicts.lexicon.skip_part)).drop("StudyPart")
    e = ents.where("field = 'description'").select("report_id", "path", "orientation")
    some = e.select("report_id").distinct()
    hit = exams.join(e, "report_id").where(_same_part(e) & ~opposite(F.col("exam_side"), F.col("orientation"))).select("report_id", "exam").distinct()
    return exams.join(some, "report_id", "left_semi").select("report_id", "exam").distinct().join(hit, ["report_id", "exam"], "left_anti")


def part_inverse(reports: DataFrame, ents: DataFrame, dicts: Dictionaries = DEFAULT, exams: DataFrame | None = None) -> DataFrame:
    """(report_id, sentence): entities of an exam's part that lie on the opposite side of every such exam."""
    exams = (exam_parts(reports, dicts) if exams is None else exams).drop("StudyPart")
    e = ents.where("field = 'description'").select("report_id", "sentence_index", "sentence", "start", "path", "orientation")
    pairs = exams.join(e, "report_id").where(_same_part(e))
    all_far = F.bool_and(opposite(F.col("exam_side"), F.col("orientation")))
    return pairs.groupBy("report_id", "sentence_index", "sentence", "start").agg(all_far.alias("far")).where("far").select("report_id", "sentence").distinct()


def illness_similarity(a: Column, b: Column) -> Column:
    """The best likeness of the parts of two findings: one half where one holds the other, else that of their character pairs.

    ``word_vectors.Likeness`` is the other measure that checks take.
    """
    parts = lambda c: F.filter(F.transform(F.split(c, "[,，]"), F.trim), lambda x: x != "")
    one = lambda x, y: F.when(F.contains(x, y) | F.contains(y, x), 0.5).otherwise(bigram_similarity(x, y))
    return F.coalesce(F.array_max(F.flatten(F.transform(parts(a), lambda x: F.transform(parts(b), lambda y: one(x, y))))), F.lit(0.0))


def match_score(d: str, c: str, alike: Column | None = None) -> Column:
    """0.3 for the part and 0.7 for the finding: a related part counts 0.7, less 0.1 on another side; a finding of another
    polarity loses 0.2, and one that is hardly alike makes the score zero. alike: the findings' likeness, else that of character pairs."""
    part = F.when(F.col(f"{d}orientation") != F.col(f"{c}orientation"), 0.6).otherwise(0.7)
    alike = illness_similarity(F.col(f"{d}illness"), F.col(f"{c}illness")) if alike is None else alike
    ill = alike - F.when((F.col(f"{d}positive") >= 2) != (F.col(f"{c}positive") >= 2), 0.2).otherwise(0.0)
    return F.when(F.round(ill, 9) < 0.1, 0.0).otherwise(F.round(0.3 * part + 0.7 * ill, 6))


#: A function of (pairs, column, column) that adds the column ``similarity``, as ``word_vectors.Likeness`` does.
Measure = Callable[[DataFrame, str, str], DataFrame]


def candidates(ents: DataFrame, likeness: Measure | None = None) -> DataFrame:
    """Description entities with their conclusion candidates: related paths, and a score."""
    keep = ["sentence_index", "sentence", "start", "position", "path", "orientation", "illness", "positive"]
    pick = lambda f, p: ents.where(F.col("field") == f).select("report_id", *(F.col(c).alias(p + c) for c in keep))
    pairs = pick("description", "d_").join(pick("conclusion", "c_"), "report_id").where(related(F.col("d_path"), F.col("c_path")))
    if likeness is None:
        return pairs.withColumn("score", match_score("d_", "c_"))
    return likeness(pairs, "d_illness", "c_illness").withColumn("score", match_score("d_", "c_", F.col("similarity"))).drop("similarity")


def forced_matches(ents: DataFrame) -> DataFrame:
    """(report_id, description, conclusion): a part that the description holds once and positively stands for a positive conclusion on it, however worded."""
    once = ents.where("field = 'description'").groupBy("report_id", "position").agg(F.count("*").alias("n")).where("n = 1").select("report_id", F.col("position").alias("d_position"))
    pairs = candidates(ents).where("d_positive >= 2 AND c_positive >= 2").where(~opposite(F.col("d_orientation"), F.col("c_orientation")))
    return pairs.join(once, ["report_id", "d_position"], "left_semi").select("report_id", F.col("d_sentence").alias("description"), F.col("c_sentence").alias("conclusion")).distinct()


def conclusion_missing(ents: DataFrame) -> DataFrame:
    """(report_id, sentence): positive described sentences of which no entity has a compatible conclusion.

    Either one's position must be a node of the other's path, and the sides must not be opposite. A forced match asks for
    both and more, so it never adds one here; it decides among the candidates of swapped sides.
    """
    d = ents.where("field = 'description' AND positive = 3").select("report_id", "sentence_index", "sentence", "position", "path", "orientation")
    c = ents.where("field = 'conclusion' AND positive >= 2").select("report_id", F.col("position").alias("c_position"), F.col("path").alias("c_path"), F.col("orientation").alias("c_side"))
    meets = on_path(F.col("path"), F.col("c_position")) | on_path(F.col("c_path"), F.col("position"))
    hit = d.join(c, "report_id").where(meets & ~opposite(F.col("orientation"), F.col("c_side"))).select("report_id", "sentence_index").distinct()
    return d.join(hit, ["report_id", "sentence_index"], "left_anti").select("report_id", "sentence").distinct()


def missing_conclusions(reports: DataFrame, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """(report_id, sentence): what ``conclusion_missing`` finds in reports, looked for once in each different pair of texts."""
    return once(reports, ["ReportStr", "ConclusionStr"], lambda r: conclusion_missing(entities(r, dicts=dicts)))


def orient_errors(ents: DataFrame, likeness: Measure | None = None) -> DataFrame:
    """(report_id, description, conclusion): the likeliest swapped sides, one for each described and each concluded sentence."""
    far = opposite(F.col("d_orientation"), F.col("c_orientation"))
    pairs = candidates(ents, likeness).where("d_positive >= 2 AND score >= 0.15").groupBy("report_id", "d_sentence", "c_sentence").agg(F.max(F.when(far, F.col("score"))).alias("s"), F.max(F.when(~far, F.col("score"))).alias("r"))
    by = lambda c: F.max("r").over(Window.partitionBy("report_id", c))
    w = pairs.withColumn("best_d", by("d_sentence")).withColumn("best_c", by("c_sentence")).where("s IS NOT NULL")
    rp, cp = (F.when(F.col(b).isNull(), 1.0).otherwise(F.round(F.col("s") - F.col(b), 6)) for b in ("best_d", "best_c"))
    w = w.withColumn("rp", rp).withColumn("cp", cp).where("rp > 0 AND ((cp > 0.006 AND s >= 0.5) OR (cp = 1 AND s >= 0.4))").withColumn("total", F.round(F.col("rp") + F.col("cp"), 6))
    for side, other in (("d_sentence", "c_sentence"), ("c_sentence", "d_sentence")):
        order = Window.partitionBy("report_id", side).orderBy(F.desc("total"), other)
        w = w.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return w.select("report_id", F.col("d_sentence").alias("description"), F.col("c_sentence").alias("conclusion"))


def apply_missing(reports: DataFrame, ents: DataFrame, exams: DataFrame) -> DataFrame:
    """(report_id, part): parts that the request form names and no exam covers. ents: with rows of field ``apply``."""
    a = ents.where("field = 'apply'").select("report_id", F.col("position").alias("part"), "path", "orientation").distinct()
    e = exams.select("report_id", "exam_path", "exam_side")
    hit = a.join(e, "report_id").where(related(F.col("path"), F.col("exam_path")) & ~opposite(F.col("orientation"), F.col("exam_side"))).select("report_id", "part").distinct()
    some = e.select("report_id").distinct()
    return a.join(some, "report_id", "left_semi").select("report_id", "part").distinct().join(hit, ["report_id", "part"], "left_anti")


def application_form(reports: DataFrame, ents: DataFrame, exams: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(report_id, message): one line on all exam parts, with their sides, that the request form gives no reason for. ents: with rows of field ``apply``.

    Orders that are left out by their wording, or name no part, have no line.
    """
    a = ents.where("field = 'apply'").select("report_id", "position", "path", "orientation")
    e = exams.where(~F.col("StudyPart").rlike(lexicon.skip_part)).select("report_id", "exam", "exam_path", "exam_side").distinct()
    fits = (on_path(F.col("path"), F.col("exam")) | on_path(F.col("exam_path"), F.col("position"))) & ~opposite(F.col("orientation"), F.col("exam_side"))
    named = e.join(a, "report_id").where(fits).select("report_id", "exam", "exam_side").distinct()
    left = e.select("report_id", "exam", "exam_side").distinct().join(named, ["report_id", "exam", "exam_side"], "left_anti")
    parts = F.array_join(F.sort_array(F.collect_set(F.concat("exam_side", "exam"))), ",")
    return left.groupBy("report_id").agg(F.concat(F.lit("申请单中缺乏对“"), parts, F.lit("”的检查原因详细描述")).alias("message"))


def apply_orient(reports: DataFrame, dicts: Dictionaries = DEFAULT, ents: DataFrame | None = None) -> DataFrame:
    """(report_id, report_sentence, apply_sentence): sides in the request form that only contradict the report."""
    ents = entities(reports, ("apply", "description"), dicts) if ents is None else ents
    a = ents.where("field = 'apply'").select("report_id", F.col("sentence").alias("apply_sentence"), F.col("path").alias("a_path"), F.col("orientation").alias("a_side"))
    r = ents.where("field = 'description'").select("report_id", F.col("sentence").alias("report_sentence"), "path", "orientation")
    pairs = a.join(r, "report_id").where(related(F.col("a_path"), F.col("path"))).withColumn("far", opposite(F.col("a_side"), F.col("orientation")))
    w = Window.partitionBy("report_id", "apply_sentence", "a_path")
    return pairs.withColumn("all_far", F.min(F.col("far").cast("int")).over(w)).where("all_far = 1").select("report_id", "report_sentence", "apply_sentence").distinct()


def contradictions(ents: DataFrame, lexicon: Lexicon = LEXICON, likeness: Measure | None = None) -> DataFrame:
    """(report_id, neg, pos): a negative and a positive sentence on one key part and compatible sides that speak of one aspect.

    For a negative its aspects are tried in order; of the positives with an aspect the least alike stands for it, if it
    is unlike enough. A negative without any aspect meets all positives whose stretch of the organ isn't another one.
    """
    keys = F.array(*map(F.lit, lexicon.key_part.split("|")))
    base = ents.where(~F.col("sentence").rlike(lexicon.contradiction_exclude) & ~F.col("sentence").rlike(f"(?i){lexicon.ignore_sentence}"))
    base = base.withColumn("organs", F.array_intersect(F.split("path", ">"), keys)).where(F.size("organs") > 0)
    at = F.struct("field", "sentence_index", "start", "match_no")
    said = F.length(F.regexp_replace("illness", lexicon.filler, "")) > 1
    neg = base.where((F.col("positive") <= 1) & (F.col("measure") == 0) & said).select("report_id", at.alias("n_at"), F.col("sentence").alias("neg"), F.col("position").alias("n_position"), F.col("organs").alias("n_organs"), F.col("orientation").alias("n_side"), F.posexplode("attribute").alias("k", "aspect"))
    pos = base.where("positive >= 2").select("report_id", at.alias("p_at"), F.col("sentence").alias("pos"), "path", "organs", "orientation", "attribute")
    meets = on_path(F.col("path"), F.col("n_position")) & F.arrays_overlap("organs", "n_organs") & ~opposite(F.col("n_side"), F.col("orientation"))
    parts = lambda c: F.regexp_extract_all(F.col(c), F.lit(lexicon.sub_part), F.lit(0))
    free = (F.col("aspect") == "other_description") & ((F.size(parts("neg")) == 0) | (F.size(parts("pos")) == 0) | F.arrays_overlap(parts("neg"), parts("pos")))
    pairs = neg.join(pos, "report_id").where(meets & (free | ((F.col("aspect") != "other_description") & F.array_contains("attribute", F.col("aspect")))))
    pairs = pairs.withColumn("similarity", F.round(bigram_similarity(F.col("neg"), F.col("pos")), 6)) if likeness is None else likeness(pairs, "neg", "pos")
    best = pairs.groupBy("report_id", "neg", "n_at", "k").agg(F.min_by("pos", F.struct("similarity", "p_at", "pos")).alias("pos"), F.min("similarity").alias("similarity")).where(F.col("similarity") <= lexicon.alike)
    return best.groupBy("report_id", "neg", "n_at").agg(F.min_by("pos", "k").alias("pos")).select("report_id", "neg", "pos").distinct()


def required(pattern: str) -> set[str] | None:
    """Literals of which a text that fits the pattern holds at least one; None if the pattern promises none."""
    def best(options: list[set[str]]) -> set[str] | None:
        return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)

    def of(items) -> set[str] | None:
        options, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is re_parser.LITERAL:
                run += chr(arg)
                continue
            if run:
                options.append({run})
                run = ""
            if op is re_parser.SUBPATTERN and not arg[1]:
                options.append(of(arg[3]))
            elif op is re_parser.BRANCH:
                parts = [of(b) for b in arg[1]]
                options.append(None if None in parts else set().union(*parts))
            elif op in (re_parser.MAX_REPEAT, re_parser.MIN_REPEAT) and arg[0] > 0:
                options.append(of(arg[2]))
        return best([o for o in options if o])

    tree = re_parser.parse(pattern)
    return None if tree.state.flags & re.IGNORECASE else of(tree)


@F.pandas_udf(T.ArrayType(T.StringType()))
def literals(pattern: pd.Series) -> pd.Series:
    """What ``required`` finds, in order; null for none."""
    return pattern.map(lambda p: sorted(required(p) or ()) or None)


def rule_hits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(sentence, part, rule): which of the rules (rule, pattern, part) fit the rows' sentences, for parts on the rows' paths.

    Each different sentence is looked at once. Rules meet it on the literals that their pattern can't do without, all
    found in one walk along the sentence; rules without such meet it on the part. Only then the pattern is tried. Rules
    stay where they are; the different literals, as many as a task may hold, are sent.
    """
    given = stored(rules.select("rule", "pattern", "part", literals("pattern").alias("terms")))
    by_literal = given.select("rule", "pattern", "part", F.explode("terms").alias("term"))
    bare = given.where("terms IS NULL").drop("terms")
    at = stored(rows.select("sentence", F.explode(F.split("path", ">")).alias("part")).distinct())
    terms = [r["term"] for r in by_literal.select("term").distinct().limit(MOST + 1).collect()]
    seen = with_places(at.select("sentence").distinct(), terms, first_only=True).select("sentence", "term")
    first = at.join(seen.join(by_literal, "term").drop("term").distinct(), ["sentence", "part"])
    return first.unionByName(at.join(bare, "part")).where("sentence RLIKE pattern").select("sentence", "part", "rule")


def critical_values(reports: DataFrame, ents: DataFrame, dicts: Dictionaries = DEFAULT, rules: DataFrame | None = None) -> DataFrame:
    """(report_id, rule, category, description): for each rule the first concluded entity that passes all gates.

    rules: a table (rule, device, pattern, part, least, described, category) instead of the dictionary's.
    """
    if rules is None:
        rules = reports.sparkSession.createDataFrame(list(dicts.critical), "rule int, device string, pattern string, part string, least double, described string, category string")
    c = ents.where(f"field = 'conclusion' AND NOT sentence RLIKE '{dicts.lexicon.critical_ignore}'").select("report_id", "sentence", "sentence_index", "start", "path")
    fits = stored(rule_hits(c, rules))
    keyed = c.select("report_id", "sentence", "sentence_index", "start", F.explode(F.array_distinct(F.split("path", ">"))).alias("part")).join(reports.select("report_id", "modality"), "report_id")
    hit = keyed.join(fits, ["sentence", "part"]).join(rules.select("rule", "device", "least", "described", "category"), "rule").where("modality RLIKE device")
    hit = hit.select("report_id", "rule", "category", "part", "least", "described", "sentence", "sentence_index", "start")
    d = ents.select("report_id", F.col("field").alias("d_field"), F.col("path").alias("d_path"), F.col("sentence").alias("d_sentence"), F.col("measure").alias("d_mm"), F.col("percent").alias("d_percent"))
    big = F.when(F.col("least") < 1, F.col("d_percent") >= F.col("least")).otherwise(F.col("d_mm") >= F.col("least"))
    second = F.when(F.col("least") > 0, big & F.array_contains(F.split("d_path", ">"), F.col("part"))).otherwise((F.col("d_field") == "description") & F.expr("d_sentence RLIKE described"))
    more = (F.col("least") > 0) | (F.col("described") != "")
    keep = ["report_id", "rule", "category", "sentence", "sentence_index", "start"]
    ok = hit.where(~more).select(*keep).unionByName(hit.where(more).join(d, "report_id").where(second).select(*keep)).distinct()
    w = Window.partitionBy("report_id", "rule").orderBy("sentence_index", "start", "sentence")
    return ok.withColumn("n", F.row_number().over(w)).where("n = 1").select("report_id", "rule", "category", F.col("sentence").alias("description"))


def rule_counts(reports: DataFrame, rules: DataFrame, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """(rule, part, n_reports, first_report): how many reports ``critical_values`` finds for each rule of a table, and the least of them.

    Rules that agree in all but their number are tried once, and reports that agree in all that rules look at are
    looked at once: what rules and reports share out grows with what differs, not with their product.
    """
    same = ["device", "pattern", "part", "least", "described", "category"]
    kinds = stored(rules.groupBy(*same).agg(F.min("rule").alias("rule")))
    more = bool(kinds.where("least > 0 OR described <> ''").take(1))  # else no rule looks beyond the conclusion
    texts = ["ConclusionStr", "ReportStr"] if more else ["ConclusionStr"]
    each = counted(reports, ["modality", *texts])
    ents = stored(entities(each, ("description", "conclusion") if more else ("conclusion",), dicts))
    found = critical_values(each.drop("n").distinct(), ents, dicts, kinds).select("report_id", "rule")
    found = found.join(each.select("report_id", "n").distinct(), "report_id").groupBy("rule").agg(F.sum("n").alias("n_reports"), F.min("report_id").alias("first_report"))
    found = stored(found.join(kinds, "rule").drop("rule"))
    rules = rules.select("rule", *same).distinct()
    return rules.join(found, [rules[c].eqNullSafe(found[c]) for c in same]).select("rule", rules["part"], "n_reports", "first_report")


def complexity(reports: DataFrame, ents: DataFrame) -> DataFrame:
    """(report_id, complexity): modality's weight times positives plus one, of the larger of the two fields; 0 without entities."""
    n = ents.groupBy("report_id", "field").agg(F.count_if(F.col("positive") >= 2).alias("n"), F.count("*").alias("all_n"))
    w = Window.partitionBy("report_id").orderBy(F.desc("all_n"), "field")
    n = n.withColumn("k", F.row_number().over(w)).where("k = 1")
    weight = F.create_map(*(F.lit(x) for kv in COMPLEXITY.items() for x in kv))
    base = F.coalesce(F.try_element_at(weight, modality(F.col("modality"))), F.lit(0.0))
    return reports.join(n, "report_id", "left").select("report_id", F.when(F.col("n").isNull(), 0.0).otherwise(F.round(base * (F.col("n") + 1), 6)).alias("complexity"))


def positive_parts(ents: DataFrame) -> DataFrame:
    """(report_id, root, parts, any_positive): positive positions below each root, joined in order, or that it is negative."""
    root = F.element_at(F.split("path", ">"), 1)
    parts = F.array_join(F.array_sort(F.collect_set(F.when(F.col("positive") >= 2, F.col("position")))), "；")
    parts = F.when(parts == "", "阴性").otherwise(parts)
    return ents.groupBy("report_id", root.alias("root")).agg(parts.alias("parts"), F.bool_or(F.col("positive") >= 2).alias("any_positive"))


def error_rates(report: DataFrame, columns: list[str]) -> DataFrame:
    """(check_name, rate): the share of reports that each check flags."""
    flags = F.array(*(F.struct(F.lit(c).alias("check_name"), F.col(c).isNotNull().cast("double").alias("hit")) for c in columns))
    return report.select(F.explode(flags).alias("f")).groupBy("f.check_name").agg(F.round(F.avg("f.hit"), 6).alias("rate"))


