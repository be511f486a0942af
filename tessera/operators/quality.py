"""The whole check of a report: all findings, filtered by verdicts, in one row.

Entities of the description, the conclusion, the order and the request form are derived
once and written; every check reads them. Findings are rows of one table, so verdicts are
one join and the report one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.dictionaries import DEFAULT, Dictionaries
from tessera.operators import checks
from tessera.operators.alike import once
from tessera.operators.entities import entities
from tessera.scratch import stored

#: Checks whose findings a model may judge.
JUDGED = ("conclusion_missing", "orient_error", "contradiction", "sex_error")
LISTS = ("partmissing", "partinverse", "special_missing", "conclusion_missing", "orient_error", "contradiction", "none_standard_term", "measure_unit_error", "apply_orient", "critical_value", "grammer_error", "sex_error", "RADS")


def findings(reports: DataFrame, dicts: Dictionaries = DEFAULT, grammar: DataFrame | None = None) -> DataFrame:
    """(report_id, check_name, item): all findings of all checks, one a row.

    Checks of parts, of the conclusion and of contradictions need a modality that is checked; operations skip the parts,
    bone ages the conclusion. grammar: (report_id, item), errors that were found by the grammar operators.
    """
    ents = stored(entities(reports, ("description", "conclusion", "title", "apply"), dicts))
    body = ents.where("field IN ('description', 'conclusion')")
    exams = stored(checks.exam_parts(reports, dicts, ents))
    lexicon = dicts.lexicon
    checked = reports.where(F.col("modality").rlike(lexicon.check_modality)).select("report_id")
    grown = reports.where(F.col("modality").rlike(lexicon.check_modality) & ~F.contains("StudyPart", F.lit(lexicon.skip_apply))).select("report_id")
    operated = reports.where(~F.col("StudyPart").rlike(lexicon.skip_part)).join(checked, "report_id", "left_semi").select("report_id")
    only = lambda df, gate: df.join(gate, "report_id", "left_semi")

    def rows(df: DataFrame, name: str, item: str | Column) -> DataFrame:
        return df.select("report_id", F.lit(name).alias("check_name"), (F.col(item) if isinstance(item, str) else item).alias("item"))

    parts = [
        rows(only(checks.part_missing(reports, body, dicts, exams), operated), "partmissing", "exam"),
        rows(only(checks.part_inverse(reports, body, dicts, exams), operated), "partinverse", "sentence"),
        rows(checks.special_missing(reports, lexicon), "special_missing", "missing"),
        rows(only(checks.conclusion_missing(body), grown), "conclusion_missing", "sentence"),
        rows(only(checks.orient_errors(body), grown), "orient_error", F.concat(F.lit("[描述]"), "description", F.lit("；[结论]"), "conclusion")),
        rows(only(checks.contradictions(body, lexicon), checked), "contradiction", F.concat("neg", F.lit("｜"), "pos")),
        rows(checks.critical_values(reports, body, dicts), "critical_value", F.concat_ws("｜", F.col("rule").cast("string"), "category", "description")),
        rows(checks.nonstandard_terms(reports, lexicon), "none_standard_term", "term"),
        rows(checks.measure_errors(reports, lexicon), "measure_unit_error", "measure_text"),
        rows(checks.apply_orient(reports, dicts, ents), "apply_orient", "apply_sentence"),
        rows(checks.sex_conflicts(reports, lexicon), "sex_error", "sex_error"),
        rows(checks.rads_missing(reports), "RADS", "rads"),
    ]
    if grammar is not None:
        parts.append(rows(grammar, "grammer_error", "item"))
    return reduce(lambda x, y: x.unionAll(y), parts).distinct()


def judged(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """found after the verdicts (report_id, check_name, item, is_valid, confidence) of a model.

    Sure ones stay, weak ones are marked, others go; those that the model couldn't judge are counted in one line. What
    wasn't asked stays.
    """
    keys = ["report_id", "check_name", "item"]
    j = found.join(verdicts.select(*keys, "is_valid", "confidence").withColumn("asked", F.lit(True)), keys, "left")
    c = F.col("confidence")
    action = F.when(F.col("asked").isNull(), "keep").when(F.col("is_valid").isNull(), "review").when(F.col("is_valid") & (c >= 0.7), "keep").when(F.col("is_valid") & (c >= 0.5), "weak").otherwise("drop")
    j = j.select(*keys, action.alias("action"))
    kept = j.where("action IN ('keep', 'weak')").select("report_id", "check_name", F.when(F.col("action") == "weak", F.concat(F.lit("[弱阳性]"), "item")).otherwise(F.col("item")).alias("item"))
    review = j.where("action = 'review'").groupBy("report_id", "check_name").agg(F.concat(F.lit("[待审核]"), F.count("*").cast("string"), F.lit("项")).alias("item"))
    return kept.unionByName(review)


def quality_report(reports: DataFrame, dicts: Dictionaries = DEFAULT, grammar: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """(report_id, one sorted array for each check): every report; a check without finding is null."""
    found = findings(reports, dicts, grammar)
    if verdicts is not None:
        found = judged(found, verdicts)
    return in_rows(reports, found)


#: Checks of the older engine's report.
OLDER = ("conclusion_missing", "measure_unit_error", "none_standard_term")


def older_lists(reports: DataFrame, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """(report_id, one sorted array for each of the ``OLDER`` checks): reports with any finding, all rows of a report together."""
    found = (checks.conclusion_missing(entities(reports, dicts=dicts)), checks.measure_errors(reports, dicts.lexicon), checks.nonstandard_terms(reports, dicts.lexicon))
    rows = reduce(lambda x, y: x.unionAll(y), (df.select("report_id", F.lit(name).alias("check_name"), F.col(df.columns[1]).alias("item")) for name, df in zip(OLDER, found, strict=True)))
    return rows.groupBy("report_id").agg(*(F.sort_array(F.collect_set(F.when(F.col("check_name") == name, F.col("item")))).alias(name) for name in OLDER))


def older_report(reports: DataFrame, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """``older_lists`` of every report, those without a finding included. Reports of equal modality and texts are looked at once."""
    return once(reports, ["modality", "ReportStr", "ConclusionStr"], lambda r: older_lists(r, dicts), "left")


def in_rows(reports: DataFrame, found: DataFrame) -> DataFrame:
    empty = reports.select("report_id", F.lit(None).cast("string").alias("check_name"), F.lit(None).cast("string").alias("item"))

    def items(name: str) -> Column:
        all_ = F.sort_array(F.collect_set(F.when(F.col("check_name") == name, F.col("item"))))
        return F.when(F.size(all_) > 0, all_).alias(name)

    return found.unionAll(empty).groupBy("report_id").agg(*map(items, LISTS))
