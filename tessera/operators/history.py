"""Queries over time and versions: search, audit, history, missed diagnosis, fees, templates, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.operators.entities import entities, graph, opposite, related


def structured_store(reports: DataFrame) -> DataFrame:
    """The searchable table: an entity a row, with its path as level columns."""
    nodes = F.split("path", ">")
    levels = [F.get(nodes, F.lit(k)).alias(f"part_level{k}") for k in range(6)]
    return entities(reports).select("report_id", "field", F.col("sentence").alias("primary_sentence"), *levels, "orientation", (F.col("positive") >= 2).alias("positive"), "measure", F.col("percent").alias("value_percent"), "illness")


def condition(part: str, side: str = "", positive: bool | None = None, least_mm: float | None = None, finding: str = "") -> Column:
    """A predicate on the store; built as an expression, so nothing is spliced into text."""
    c = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"part_level{k}") == part, F.lit(False)) for k in range(6)))
    if side:
        c &= F.col("orientation") == side
    if positive is not None:
        c &= F.col("positive") == F.lit(positive)
    if least_mm is not None:
        c &= F.col("measure") > least_mm
    if finding:
        c &= F.contains("illness", F.lit(finding))
    return c


def search(store: DataFrame, every: list[Column] = (), some: list[Column] = (), none: list[Column] = ()) -> DataFrame:
    """(report_id): reports that meet every condition, any of ``some`` and none of ``none``; positives are needed."""
    if not every and not some:
        raise ValueError("a search needs a positive condition")
    if every and some:
        raise ValueError("AND and OR can't be mixed")
    ids = lambda c: store.where(c).select("report_id").distinct()
    out = reduce(lambda a, b: a.unionByName(b), map(ids, some)).distinct() if some else reduce(lambda a, b: a.join(b, "report_id", "left_semi"), map(ids, every))
    return reduce(lambda a, c: a.join(ids(c), "report_id", "left_anti"), none, out)


def text_query(text: str) -> tuple[list[Column], list[Column], list[Column]]:
    """Conditions of a written query: clauses joined by 和/and or 或/or, negated by 没有/不/无."""
    ands, ors = ("和" in text or " and " in text), ("或" in text or " or " in text)
    if ands and ors:
        raise ValueError("AND and OR can't be mixed")
    import re

    names = sorted({r[0]: r[1] for r in fx.kg_rows()}.items(), key=lambda x: -len(x[0]))
    plus, minus = [], []
    for clause in re.split(r"和|或| and | or |[,，]", text):
        hit = next(((n, p) for n, p in names if n in clause), None)
        if hit is None:
            continue
        side = next((s for s in "左右双" if s in clause.split(hit[0])[0]), "")
        size = re.search(r"(?:大于|>|超过)\s*(\d+(?:\.\d+)?)\s*(mm|cm|m)", clause)
        mm = float(size[1]) * {"mm": 1, "cm": 10, "m": 1000}[size[2]] if size else None
        finding = re.sub(r"(?:大于|>|超过).*", "", clause.split(hit[0], 1)[1]).strip(" 有的")
        negative = bool(re.search("没有|不|无", clause))
        (minus if negative else plus).append(condition(hit[1], side, None, mm, re.sub("没有|不|无", "", finding)))
    return ([], plus, minus) if ors else (plus, [], minus)


def audit_versions(reports: DataFrame) -> DataFrame:
    """(report_id, field, before, after): sentences of two versions of a report; the audit rewrites by fixed rules."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("t")) for f, c in (("description", "ReportStr"), ("conclusion", "ConclusionStr"))))
    long = reports.select("report_id", F.explode(fields).alias("x")).select("report_id", "x.field", "x.t")
    parts = lambda c: F.filter(F.split(c, "。"), lambda s: s != "")
    even = F.pmod("report_id", F.lit(3))
    after = F.when(even == 0, F.replace(F.col("t"), F.lit("左"), F.lit("右"))).when(even == 1, F.concat("t", F.lit("建议复查。"))).otherwise(F.col("t"))
    return long.select("report_id", "field", parts(F.col("t")).alias("before"), parts(after).alias("after"))


def audit_diff(versions: DataFrame) -> DataFrame:
    """(report_id, field, added, deleted): sentences of one version only."""
    join = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), "；")
    return versions.select("report_id", "field", join("after", "before").alias("added"), join("before", "after").alias("deleted")).where("added <> '' OR deleted <> ''")


def history_latest(events: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id, day): the latest rows of each user and type, ties kept."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"))
    return events.withColumn("r", F.rank().over(w)).where("r = 1").select("user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def patient_entities(reports: DataFrame, orders: DataFrame) -> DataFrame:
    """Entities with the patient and date of their order."""
    o = orders.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("patient"), F.col("o_orderdate").cast("date").alias("day"))
    return entities(reports).join(o, "report_id")


def history_summary(ents: DataFrame) -> DataFrame:
    """(patient, position, day, sentence): of each patient's positive positions the latest sentences."""
    w = Window.partitionBy("patient", "position").orderBy(F.desc("day"))
    pos = ents.where("positive >= 2 AND field = 'description'")
    return pos.withColumn("r", F.rank().over(w)).where("r = 1").select("patient", "position", F.date_format("day", "yyyy-MM-dd").alias("day"), "sentence").distinct()


def missed_diagnosis(ents: DataFrame) -> DataFrame:
    """(patient, report_id, sentence): earlier positive sentences whose part the latest conclusion doesn't mention."""
    last = ents.groupBy("patient").agg(F.max("day").alias("last_day"))
    e = ents.join(last, "patient")
    old = e.where("positive = 3 AND field = 'description' AND day < last_day").select("patient", "report_id", "sentence", "path", "orientation")
    new = e.where("field = 'conclusion' AND day = last_day").select("patient", F.col("path").alias("n_path"), F.col("orientation").alias("n_side")).distinct()
    hit = old.join(new, "patient").where(related(F.col("path"), F.col("n_path")) & ~opposite(F.col("orientation"), F.col("n_side"))).select("patient", "report_id", "sentence").distinct()
    return old.select("patient", "report_id", "sentence").distinct().join(hit, ["patient", "report_id", "sentence"], "left_anti")


def merged_intervals(spans: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): overlapping or touching intervals of a key as one."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(top >= F.col("lo"), 0).otherwise(1))
    island = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def part_units(ents: DataFrame) -> DataFrame:
    """(report_id, units): lengths of the covered axis, in started hundreds, summed over islands."""
    spans = ents.where("field = 'description'").select("report_id", "lo", "hi").distinct()
    return merged_intervals(spans, "report_id").groupBy("report_id").agg(F.sum(F.ceil((F.col("hi") - F.col("lo")) / 100)).alias("units"))


def part_summary(ents: DataFrame) -> DataFrame:
    """(report_id, root, positions, sides): what is described below each root."""
    root = F.element_at(F.split("path", ">"), 1)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "；")
    return ents.where("field = 'description'").groupBy("report_id", root.alias("root")).agg(join("position").alias("positions"), join(F.when(F.col("orientation") != "", F.col("orientation"))).alias("sides"))


def fees(reports: DataFrame, ents: DataFrame, per_part: int = 300, enhanced: int = 100, base: int = 100) -> DataFrame:
    """(report_id, fee): a price for each unit, for enhancement, and a base."""
    extra = F.when(F.contains("StudyPart", F.lit("增强")), enhanced).otherwise(0)
    return reports.join(part_units(ents), "report_id", "left").select("report_id", (F.coalesce("units", F.lit(0)) * per_part + extra + base).cast("long").alias("fee"))


def version_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key columns plus change: added or deleted between two result tables."""
    a, b = old.select(*key).distinct().withColumn("in_old", F.lit(True)), new.select(*key).distinct().withColumn("in_new", F.lit(True))
    j = a.join(b, key, "full_outer")
    return j.select(*key, F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").alias("change")).where("change IS NOT NULL")


def template_match(reports: DataFrame, ents: DataFrame, spark: SparkSession, k: int = 3) -> DataFrame:
    """(report_id, template, score, rank): description templates of the graph's roots by the share of their nodes that a report covers."""
    t = graph(spark).where("keyword = position").select(F.element_at(F.split("path", ">"), 1).alias("template"), F.col("position").alias("t_pos"))
    sizes = t.groupBy("template").agg(F.count_distinct("t_pos").alias("all_n"))
    got = ents.where("field = 'description'").select("report_id", "position").distinct().join(F.broadcast(t), F.col("position") == F.col("t_pos")).groupBy("report_id", "template").agg(F.count_distinct("position").alias("n"))
    scored = got.join(F.broadcast(sizes), "template").withColumn("score", F.round(F.col("n") / F.col("all_n"), 6))
    w = Window.partitionBy("report_id").orderBy(F.desc("score"), "template")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("report_id", "template", "score", "rank")


def verdicts(spark: SparkSession) -> DataFrame:
    """(candidate_id, action): what becomes of a finding after a model's verdict."""
    v = spark.createDataFrame(fx.VERDICTS, "candidate_id int, is_valid boolean, confidence double, reason string")
    c = F.col("confidence")
    return v.select("candidate_id", F.when(F.col("is_valid").isNull(), "needs_review").when(F.col("is_valid") & (c >= 0.7), "keep").when(F.col("is_valid") & (c >= 0.5), "weak").otherwise("drop").alias("action"))


def parsed_answer(text: Column, schema: str) -> Column:
    """A model's JSON answer, taken out of the text around it; null fields where it can't be read."""
    return F.from_json(F.regexp_extract(text, "(?s)\\{.*\\}", 0), schema)
