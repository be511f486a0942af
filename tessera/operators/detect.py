"""Operators whose logic depends on order within one report, in Arrow batches over rows; no shuffle.

The dictionary is a few dozen names and goes along with the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scan


#: Different texts of which a task keeps the result.
KEPT = 20_000


def per_report(reports: DataFrame, columns: tuple[str, ...], schema: str, make: Callable[..., list[tuple]]) -> DataFrame:
    """Rows (report_id, *make(*columns)) of every report; make returns tuples in the order of the schema."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *r) for i, *v in pdf.itertuples(index=False) for r in make(*v)]
            yield pd.DataFrame(rows, columns=["report_id", *names])

    kind = reports.schema["report_id"].dataType.simpleString()
    return reports.select("report_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns)).mapInPandas(f, f"report_id {kind}, {schema}")



def structured_entities(reports: DataFrame) -> DataFrame:
    """(report_id, field, text_index, keyword, path, orientation, illness, positive, clause): all steps of structuring."""
    trie = scan.dictionary()

    def make(desc: str, conc: str, part: str) -> list[tuple]:
        exams = scan.structure(part, trie, title=True)
        out = []
        for name, text in (("description", desc), ("Conclusion", conc)):
            out += [(name, k, e.keyword, "；".join(">".join(p) for p in e.paths), e.orientation, e.illness, e.positive, e.clause) for k, e in enumerate(scan.structure(text, trie, exams))]
        return out

    return per_report(reports, ("ReportStr", "ConclusionStr", "StudyPart"), "field string, text_index int, keyword string, path string, orientation string, illness string, positive int, clause string", make)


def clauses(reports: DataFrame) -> DataFrame:
    """(report_id, sentence_index, clause, keywords): clauses that hang together, with their entities."""
    trie = scan.dictionary()

    def make(text: str) -> list[tuple]:
        out = []
        for k, (sentence, _) in enumerate(scan.split_sentences(text)):
            hits = [scan.Entity(sentence[a:b], a, b, [p for p, _ in v], [x for _, x in v]) for v, a, b in trie.spans(sentence)]
            out += [(k, c, "；".join(e.keyword for e in own)) for c, own in scan.clause_groups(sentence, hits)]
        return out

    return per_report(reports, ("ReportStr",), "sentence_index int, clause string, keywords string", make)


def findings(reports: DataFrame) -> DataFrame:
    """(report_id, text_index, keyword, illness, positive): what each entity of the description is described by."""
    trie = scan.dictionary()
    make = lambda text: [(k, e.keyword, e.illness, e.positive) for k, e in enumerate(scan.structure(text, trie))]
    return per_report(reports, ("ReportStr",), "text_index int, keyword string, illness string, positive int", make)


def disambiguated(reports: DataFrame) -> DataFrame:
    """(report_id, text_index, keyword, n_before, n_after, path): candidate paths before and after; the description names ambiguous parts."""
    trie = scan.dictionary()

    def make(desc: str, part: str) -> list[tuple]:
        text = desc.replace("肺上叶", "上叶").replace("肝右叶", "右叶").replace("卵巢", "附件")
        exams = scan.structure(part, trie, title=True)
        return [(k, e.keyword, len(trie.get(e.keyword)), len(e.paths), "；".join(">".join(p) for p in e.paths)) for k, e in enumerate(scan.structure(text, trie, exams))]

    return per_report(reports, ("ReportStr", "StudyPart"), "text_index int, keyword string, n_before int, n_after int, path string", make)


def merged(reports: DataFrame) -> DataFrame:
    """(report_id, kind, keyword, path): entities that hierarchical merging leaves, in descriptions and in titles."""
    trie = scan.dictionary()

    def rows(kind: str, text: str, known: dict[tuple, list[tuple]]) -> list[tuple]:
        """Reports repeat descriptions and titles: a task keeps what it made of the last ``KEPT`` different ones."""
        if (kind, text) not in known:
            if len(known) >= KEPT:
                known.clear()
            known[kind, text] = [(kind, e.keyword, ">".join(e.paths[0])) for e in scan.structure(text, trie, title=kind == "title")]
        return known[kind, text]

    known: dict[tuple, list[tuple]] = {}  # each task has its own

    def make(desc: str, part: str) -> list[tuple]:
        return rows("report", desc, known) + rows("title", f"{part}/{desc.split('。')[0]}", known)

    return per_report(reports, ("ReportStr", "StudyPart"), "kind string, keyword string, path string", make)


def best_clauses(reports: DataFrame) -> DataFrame:
    """(report_id, sentence, clause, similarity): for each concluded sentence the described clause most like it."""
    make = lambda desc, conc: [(s, *scan.best_clause(s, desc)) for s, _ in scan.split_sentences(conc)]
    return per_report(reports, ("ReportStr", "ConclusionStr"), "sentence string, clause string, similarity double", make)


def highlighted(reports: DataFrame) -> DataFrame:
    """(report_id, html): the description with its positive entities marked."""
    trie = scan.dictionary()

    def make(text: str) -> list[tuple]:
        marks = [(a, b, 1, "part") for _, a, b in trie.spans(text)]
        return [(scan.highlight(text, marks),)]

    return per_report(reports, ("ReportStr",), "html string", make)


def corrected(rows: DataFrame, rules: tuple[tuple[str, str], ...], text: str = "sentence") -> DataFrame:
    """(report_id, field, sentence_index, corrected): sentences that a rule changes."""
    fixed = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), rules, F.col(text))
    return rows.where(F.col(text).rlike("|".join(p for p, _ in rules))).select("report_id", "field", "sentence_index", fixed.alias("corrected"))


def cosine_to_mean(vectors: DataFrame) -> DataFrame:
    """(vec_id, cosine): of each vector to the mean of its label. Sums are made by place before the shuffle; whole means come back."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", "label", v.alias("v"))
    sums = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.join(means, "label").select("vec_id", F.round(dot("v", "mean") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("mean", "mean"))), 5).alias("cosine"))


Validator = Callable[[pd.DataFrame], pd.DataFrame]


def validated(findings: DataFrame, validator: Validator | None = None) -> DataFrame:
    """findings plus (is_valid, confidence, reason) of a model behind ``validator``; without one all are null.

    Equal phrases are asked once.
    """
    schema = "phrase string, is_valid boolean, confidence double, reason string"
    asked = findings.select("phrase").distinct()
    if validator is None:
        told = asked.select("phrase", F.lit(None).cast("boolean").alias("is_valid"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("reason"))
    else:
        told = asked.mapInPandas(lambda batches: (validator(b) for b in batches), schema)
    return findings.join(told, "phrase", "left")


def enriched(nodes: DataFrame, enricher: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """nodes (path) plus a description by a model behind ``enricher``; without one it is null. Equal paths are asked once."""
    asked = nodes.select("path").distinct()
    told = asked.withColumn("description", F.lit(None).cast("string")) if enricher is None else asked.mapInPandas(lambda batches: (enricher(b) for b in batches), "path string, description string")
    return nodes.join(told, "path", "left")
