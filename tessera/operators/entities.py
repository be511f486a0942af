"""From report text to the entity table: sentences, dictionary match, laterality, measures, polarity, aspects.

Everything here is a projection, an explode or a join with a broadcast dictionary of
checked size, so a report never moves until something is asked about its entities. Names
are found in Arrow batches, by first letter, so the number of names hardly matters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import ASPECTS, LEXICON
from tessera.dictionaries import DEFAULT, Dictionaries, Names
from tessera.functions.text import all_of
from tessera.scratch import stored

FIELDS = {"description": "ReportStr", "conclusion": "ConclusionStr", "title": "StudyPart", "apply": "applyTable", "before_description": "beforeReportStr", "before_conclusion": "beforeConclusionStr"}


def sentences(reports: DataFrame, fields: tuple[str, ...] = ("description", "conclusion"), key: str = "report_id") -> DataFrame:
    """(report_id, field, sentence_index, sentence): non-empty parts between sentence ends."""
    texts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(FIELDS[f]).alias("text")) for f in fields))
    long = reports.select(key, F.explode(texts).alias("t")).select(key, "t.field", "t.text")
    parts = F.filter(F.split("text", LEXICON.sentence_end), lambda x: x != "")
    return long.select(key, "field", F.posexplode(parts).alias("sentence_index", "sentence"))


def graph(spark: SparkSession, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """(keyword, position, path, depth, lo, hi): every name of every node."""
    return dicts.graph(spark)


def length_mm(value: Column) -> Column:
    """A length with its unit in millimetres; a bare factor counts nothing."""
    number = F.regexp_extract(value, "[0-9.]+", 0).try_cast("double")
    low = F.lower(value)
    unit = F.when(low.rlike("cm|厘米"), 10.0).when(low.rlike("mm|毫米"), 1.0).when(low.rlike("m|米"), 1000.0).otherwise(0.0)
    return number * unit


def measures(text: Column) -> dict[str, Column]:
    """Longest length in mm, first percentage as a share, first volume in ml; 0 where there is none."""
    plain = F.replace(text, F.lit("*"), F.lit("×"))
    lengths = all_of(F.regexp_replace(plain, "(?i)[0-9]+([.][0-9]+)?(ml|毫升)", ""), "(?i)[0-9]+(?:[.][0-9]+)?(?:mm|cm|毫米|厘米|米|m|×)")
    percent = F.regexp_extract(plain, "([0-9.]+)[%％]", 1).try_cast("double") / 100
    volume = F.regexp_extract(plain, "(?i)([0-9]+(?:[.][0-9]+)?)(?:ml|毫升)", 1).try_cast("double")
    zero = F.lit(0.0)
    return {"measure": F.coalesce(F.array_max(F.transform(lengths, length_mm)), zero), "percent": F.coalesce(percent, zero), "volume": F.coalesce(volume, zero)}


def orientation(sentence: Column, keyword: Column, start: Column, lexicon=LEXICON) -> Column:
    """The nearest side word before the keyword at ``start``, else one in brackets after it."""
    before = F.substring(sentence, F.lit(1), start)
    after = F.substring(sentence, start + F.length(keyword) + 1, F.length(sentence))
    near = F.regexp_extract(before, "^(?:.*[^侧位])?(左|右|双|两)", 1)
    found = F.when(near != "", near).otherwise(F.regexp_extract(after, "[(（](左|右|双|两)[侧部]*?[)）]", 1))
    return F.when(keyword.rlike(lexicon.single_organ), "").otherwise(F.replace(found, F.lit("两"), F.lit("双")))


def normal_range(text: Column, m: dict[str, Column], rules=DEFAULT.normal) -> Column:
    """Whether the first rule whose keyword and value fit calls the measure normal."""
    source = {"length": m["measure"], "percent": m["percent"], "volume": m["volume"]}
    fits = [F.contains(text, F.lit(k)) & (source[p] > 0) & source[p].between(lo, hi) for k, p, lo, hi in rules]
    return reduce(lambda a, b: a | b, fits, F.lit(False))


def sick(sentence: Column, illness: Column, m: dict[str, Column], dicts: Dictionaries = DEFAULT) -> Column:
    """Whether an entity's finding is abnormal: by its measures, else by the wording of any of its parts between commas."""
    lexicon = dicts.lexicon
    measured = (m["measure"] > 0) | (m["percent"] > 0) | (m["volume"] > 0)
    absolute = lexicon.absolute_illness.split("|")

    def bad(part: Column) -> Column:
        p = F.trim(part)
        return F.when(p.isin(*absolute), True).when((p == "") | p.rlike("^未见"), False).when(p.rlike(lexicon.illness), True).otherwise((F.length(p) > 1) & ~p.rlike(lexicon.normal))

    by_words = F.exists(F.split(illness, "[,，]"), bad)
    return F.when(sentence.rlike(lexicon.ignore_entity), False).when(measured, ~normal_range(sentence, m, dicts.normal)).otherwise(by_words)


def positivity(sentence: Column, is_sick: Column, lexicon=LEXICON) -> Column:
    """0 normal, 1 physiological, 2 positive but ignorable, 3 positive."""
    return F.when(is_sick, F.when(sentence.rlike(lexicon.miss_ignore), 2).otherwise(3)).otherwise(F.when(sentence.rlike(lexicon.physiologic), 1).otherwise(0))


def aspects(illness: Column) -> Column:
    """Names of the aspects that a finding speaks of, joined by commas; built without lambdas, so that it compiles."""
    return F.concat_ws(",", *(F.when(illness.rlike(p), F.lit(n)) for n, p in ASPECTS))


def name_hits(sent: DataFrame, names: list[str], text: str = "sentence") -> DataFrame:
    """sent plus (match_no, keyword, start): leftmost, longest names, none overlapping."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Names(names)
        for b in batches:
            row, no, key, at = [], [], [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                for k, (name, start) in enumerate(find.spans(t or "")):
                    row.append(i)
                    no.append(k)
                    key.append(name)
                    at.append(start)
            part = b.take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(no, pa.int32()), pa.array(key, pa.string()), pa.array(at, pa.int32())], names=[*b.schema.names, "match_no", "keyword", "start"])

    more = [T.StructField("match_no", T.IntegerType()), T.StructField("keyword", T.StringType()), T.StructField("start", T.IntegerType())]
    return sent.mapInArrow(f, T.StructType([*sent.schema.fields, *more]))


def matches(sent: DataFrame, spark: SparkSession, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """sent plus (match_no, keyword, start, position, path, depth, lo, hi): a row for each path of each name found."""
    return name_hits(sent, dicts.names()).join(F.broadcast(graph(spark, dicts)), "keyword")


def _derived(sent: DataFrame, dicts: Dictionaries) -> DataFrame:
    """sent (…, sentence) plus all columns of its entities."""
    hit = matches(sent, sent.sparkSession, dicts)
    hit = hit.withColumn("end", F.col("start") + F.length("keyword")).withColumn("illness", F.substring("sentence", F.col("end") + 1, F.length("sentence")))
    m = measures(F.col("sentence"))
    out = hit.select(*sent.columns, "match_no", "keyword", "start", "end", "position", "path", "depth", "lo", "hi", "illness", orientation(F.col("sentence"), F.col("keyword"), F.col("start"), dicts.lexicon).alias("orientation"), *(c.alias(n) for n, c in m.items()))
    plain = F.trim(F.regexp_replace("illness", ",现|,拟|,考虑", ""))
    out = out.withColumn("finding", plain).withColumn("sick", sick(F.col("sentence"), F.col("finding"), {n: F.col(n) for n in m}, dicts)).withColumn("names", aspects(F.col("illness")))
    named = F.split(F.when(F.col("names") == "", "other_description").otherwise(F.col("names")), ",")
    return out.withColumn("positive", positivity(F.col("sentence"), F.col("sick"), dicts.lexicon)).withColumn("attribute", named).drop("finding", "sick", "names")


def entities(reports: DataFrame, fields: tuple[str, ...] = ("description", "conclusion"), dicts: Dictionaries = DEFAULT) -> DataFrame:
    """The entity table. path is ``>``-joined from the root.

    All of an entity follows from its sentence, and reports repeat their sentences: each different one is worked out once
    and stored, and the reports' sentences meet it by equality. A stream, which can't be stored, works out every one.
    """
    sent = sentences(reports, fields)
    if reports.isStreaming:
        return _derived(sent, dicts)
    each = stored(_derived(sent.select("sentence").distinct(), dicts))
    return sent.join(each, "sentence").select("report_id", "field", "sentence_index", *each.columns)


def on_path(path: Column, position: Column) -> Column:
    return F.array_contains(F.split(path, ">"), position)


def related(a: Column, b: Column) -> Column:
    """One path leads through the other."""
    return F.startswith(F.concat(a, F.lit(">")), F.concat(b, F.lit(">"))) | F.startswith(F.concat(b, F.lit(">")), F.concat(a, F.lit(">")))


def opposite(a: Column, b: Column) -> Column:
    return ((a == "左") & (b == "右")) | ((a == "右") & (b == "左"))


def numbered(ents: DataFrame) -> DataFrame:
    """ents plus text_index, counted through a report's field."""
    w = Window.partitionBy("report_id", "field").orderBy("sentence_index", "start", "match_no")
    return ents.withColumn("text_index", (F.row_number().over(w) - 1).cast("int"))


def filled_laterality(ents: DataFrame) -> DataFrame:
    """ents with the side of paired organs taken over from neighbours, in order, filled values included."""
    item = F.struct("sentence_index", "start", "match_no", "keyword", "path", "orientation")
    groups = ents.groupBy("report_id", "field").agg(F.sort_array(F.collect_list(item)).alias("xs"))

    def step(acc: Column, i: Column) -> Column:
        x = F.col("xs")[i]
        before = F.try_element_at(F.filter(acc, lambda z: z != ""), F.lit(-1))
        after = F.try_element_at(F.filter(F.transform(F.slice(F.col("xs"), i + 2, F.lit(2)), lambda z: z["orientation"]), lambda z: z != ""), F.lit(1))
        value = F.when((x["orientation"] != "") | ~x["path"].rlike(LEXICON.paired_organ), x["orientation"]).otherwise(F.coalesce(before, after, F.lit("")))
        return F.concat(acc, F.array(value))

    filled = F.aggregate(F.sequence(F.lit(0), F.size("xs") - 1), F.array().cast("array<string>"), step)
    out = groups.select("report_id", "field", F.explode(F.arrays_zip("xs", filled.alias("filled"))).alias("z"))
    return out.select("report_id", "field", "z.xs.sentence_index", "z.xs.start", "z.xs.keyword", "z.xs.orientation", F.col("z.filled").alias("filled"))
