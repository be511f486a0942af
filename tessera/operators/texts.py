"""Normalisation of report text, splitters, numbered parts, paragraphs, samples and annotation tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.dictionaries import valid_pattern
from tessera.functions import scan
from tessera.functions import text as ft

_WORD = "0-9A-Za-z_\\u4e00-\\u9fff"
#: What is counted in a paragraph of measurements.
HEADERS = ("心功能分析", "脑灌注参数", "血流动力学", "心血管形态", "心房", "心室")
TERMS = ("直径", "厚度", "大小", "容积", "面积", "分数", "舒张末期", "收缩末期", "EF值")
UNITS = ("mm", "cm", "ml", "HU", "m/s")
STRUCTURE = "[\\u4e00-\\u9fa5\\s]+：\\s*[0-9.]+"
#: A unit that no letter, digit or ideograph touches, and a percent sign between two of them.
UNIT = f"(?i)(?:^|[^{_WORD}])(?:{'|'.join(UNITS)})(?:$|[^{_WORD}])|[{_WORD}]％[{_WORD}]"


def measurement_score(text: Column) -> Column:
    """Ten for each pair of a name and a number, twenty for a leading header, one for each term and unit."""
    trimmed = F.trim(text)
    header = reduce(lambda a, b: a | b, (F.startswith(trimmed, F.lit(h)) for h in HEADERS))
    times = lambda w: ((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("long")
    return 10 * ft.count_of(text, STRUCTURE) + 20 * header.cast("long") + reduce(lambda a, b: a + b, map(times, TERMS)) + ft.count_of(text, UNIT)


def plain_paragraphs(text: Column, most: int = 5) -> Column:
    """The text without the paragraphs that list measurements; a line feed and a carriage return part them."""
    return F.array_join(F.filter(F.split(text, "\n\r"), lambda p: measurement_score(p) <= most), "\n\r")


#: Ends of sentences, as five readers of texts see them.
SPLITTERS = {"general": "[.。!！?？;；\n\r]", "short": "[。！？；，、：:;,.!?\n\r]+", "clause": "[，,。；;！？、\n\r]", "mining": "[。；!！\n]", "legacy": "[?？。；;\n\r]"}


def parts(text: Column, splitter: str) -> Column:
    """Trimmed, non-empty parts; the mining splitter drops those of under five letters."""
    least = 5 if splitter == "mining" else 1
    return F.filter(F.transform(F.split(text, SPLITTERS[splitter]), F.trim), lambda p: F.length(p) >= least)


def valid_word(word: Column) -> Column:
    """Two to six characters, not all digits nor all Latin letters, and no full-width mark."""
    return F.length(word).between(2, 6) & ~word.rlike("^[0-9]+$") & ~word.rlike("^[A-Za-z]+$") & ~word.rlike("[，。、；：？！（）【】《》]")


def safe_replace(text: Column, pattern: str, replacement: str) -> Column:
    """text with the pattern replaced; a pattern that isn't one changes nothing."""
    return F.regexp_replace(text, pattern, replacement) if valid_pattern(pattern) else text


# --- normalisation ------------------------------------------------------------------------

_SPINE = "椎|横突|棘|脊|黄韧带|肋|颈|骶|尾骨|隐裂|腰化|骶化|胸化|项韧带|纵韧带"
#: What calls for writing out: a range, a slash or a list of numbers.
EXPAND = "[0-9] *[-~—至/、] *[A-Za-z]?[0-9]"


@F.pandas_udf(T.StringType())
def written_out(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else scan.expand_parts(t))


def spine_letters(text: Column) -> Column:
    """C, T, L and S before a number as the part's character, in sentences that speak of the spine."""
    out = text
    for letter, part in (("C", "颈"), ("T", "胸"), ("L", "腰"), ("S", "骶")):
        out = F.regexp_replace(out, f"(^|[^A-Za-z0-9]){letter}([0-9])", f"$1{part}$2")
    return F.when(text.rlike(_SPINE), out).otherwise(text)


def normalised(text: Column, rules: tuple, expand: bool = True) -> Column:
    """Seven steps in order: clean, short replacements, writing out, spine letters, other replacements, patterns, tidying.

    rules: (order, pattern, replacement, is regex). Strings of under two letters stay as they are.
    """
    plain = sorted(r for r in rules if not r[3])
    put = lambda t, rs: reduce(lambda a, r: F.replace(a, F.lit(r[1]), F.lit(r[2])), rs, t)
    t = F.regexp_replace(ft.clean_space(text), " ?([，。；：、,;:]) ?", "$1")
    t = ft.drop_numbering(t)
    t = put(t, [r for r in plain if len(r[1]) <= 4])
    if expand:
        t = F.when(t.rlike(EXPAND), written_out(t)).otherwise(t)
    t = spine_letters(t)
    t = put(t, [r for r in plain if len(r[1]) > 4])
    for _, pattern, new, _ in sorted(r for r in rules if r[3]):
        t = safe_replace(t, pattern, new)
    t = ft.collapse_separators(F.regexp_replace(F.trim(t), "\\s+", " "))
    return F.when(F.length(text) < 2, text).otherwise(t)


# --- numbered parts -----------------------------------------------------------------------

_N = "([一二三四五六七八九十0-9]+)"
_RIB = "(?:腋|后|前|软|背)肋"
#: Part, highest number, patterns of which the first group is the number.
NUMBERED = (
    ("指骨", 5, (f"第{_N}指骨", "指骨([1-5])")), ("趾骨", 5, (f"第{_N}趾骨", "趾([1-5])")), ("掌骨", 5, (f"第{_N}掌骨", "掌骨([1-5])")), ("跖骨", 5, (f"第{_N}跖骨", "跖骨([1-5])")),
    ("颈椎", 7, (f"第{_N}颈椎", "C([0-9]+)", "颈椎([1-7])")), ("胸椎", 12, (f"第{_N}胸椎", "胸([0-9]+)椎体")), ("腰椎", 5, (f"第{_N}腰椎", "L([0-9]+)", "腰([0-9]+)椎体")),
    ("骶椎", 5, (f"第{_N}骶椎", "骶([0-9]+)椎体")), ("尾椎", 4, (f"第{_N}尾椎", "尾([1-4])")),
    ("肋骨", 12, (f"第{_N}肋", "肋([0-9]+)", f"第{_N}{_RIB}", f"{_N}{_RIB}", f"{_N}十[一二三四五六七八九]{_RIB}")),
    ("脑神经", 12, (f"第{_N}对脑神经",)), ("颅神经", 12, (f"第{_N}对颅神经",)), ("腕骨", 8, (f"第{_N}腕骨",)), ("跗骨", 7, (f"第{_N}跗骨",)),
)
_DIGITS = "零一二三四五六七八九十"


def number(text: Column) -> Column:
    """Digits, one Chinese numeral, or one that ends in ten; -1 for what can't be read that way."""
    one = lambda c: F.instr(F.lit(_DIGITS), c) - 1
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).when(F.length(text) == 1, one(text)).when(F.endswith(text, F.lit("十")), 10 + F.greatest(F.lit(0), one(F.substring(text, 2, 1)))).otherwise(-1)


def impossible_numbers(rows: DataFrame, text: str) -> DataFrame:
    """rows plus (part, term): numbered parts beyond their highest number, or whose number can't be read; each once."""
    def hits(part: str, most: int, pattern: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(f"(?i){pattern}"), F.lit(0)).alias("term"), F.regexp_extract_all(F.col(text), F.lit(f"(?i){pattern}"), F.lit(1)).alias("n"))
        return F.transform(both, lambda x: F.struct(F.lit(part).alias("part"), x["term"].alias("term"), x["n"].alias("n"), F.lit(most).alias("most")))

    every = F.concat(*(hits(p, m, x) for p, m, ps in NUMBERED for x in ps))
    each = rows.select("*", F.explode(every).alias("h")).withColumn("number", number(F.col("h.n")))
    return each.where((F.col("number") == -1) | (F.col("number") > F.col("h.most"))).select(*rows.columns, "h.part", "h.term").distinct()


# --- samples, ages, answers ------------------------------------------------------------------


def hash_sample(rows: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """Rows whose hash of seed and key falls in the share: the same rows in every run and at every partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent)


def tagged(rows: DataFrame, column: str, tag: str, key: str, most: int) -> DataFrame:
    """The first ``most`` rows of a tag, by key."""
    return rows.where(F.col(column) == tag).orderBy(key).limit(most)


def age_group(age: Column) -> Column:
    """newborn for days, infant for months, child up to six years, elderly from sixty, else adult; null if it can't be read."""
    n = F.regexp_extract(age, "([0-9]+)", 1).try_cast("int")
    up = F.upper(age)
    return F.when(n.isNull(), None).when(F.contains(up, F.lit("D")), "newborn").when(F.contains(up, F.lit("M")), "infant").when(n <= 6, "child").when(n >= 60, "elderly").otherwise("adult")


def repaired(text: Column) -> Column:
    """The JSON object in a model's answer: what stands around it goes, quotes, literals, trailing commas and a missing end are mended."""
    body = F.regexp_extract(text, "(?s)\\{.*", 0)
    body = F.when(F.contains(body, F.lit("}")), F.regexp_extract(body, "(?s)\\{.*\\}", 0)).otherwise(F.concat(F.trim(body), F.lit("}")))
    for pattern, new in (("'", '"'), ("\\bTrue\\b", "true"), ("\\bFalse\\b", "false"), ("\\bNone\\b", "null"), (",\\s*\\}", "}")):
        body = F.regexp_replace(body, pattern, new)
    return body


# --- annotation -------------------------------------------------------------------------------


def annotations(ents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (report_id, field, sentence_index, id, label, start_offset, end_offset, keyword) and relations (…, from_id, to_id).

    Spans of parts (ANAT) and of their findings (FIND), each once in a sentence, numbered parts first; a part is
    related to each of its findings. Spans that don't lie in the sentence, or are empty, are left out with their relation.
    """
    key = ["report_id", "field", "sentence_index"]
    inside = lambda a, b: (F.col(a) >= 0) & (F.col(a) < F.col(b)) & (F.col(b) <= F.length("sentence"))
    base = ents.select(*key, "sentence", "keyword", "start", "end", "illness", F.col("end").alias("f_start"), (F.col("end") + F.length("illness")).alias("f_end"))
    base = base.where(inside("start", "end") & inside("f_start", "f_end") & (F.col("illness") != ""))
    pick = lambda label, a, b, k: base.select(*key, F.lit(label).alias("label"), F.col(a).alias("start_offset"), F.col(b).alias("end_offset"), F.col(k).alias("keyword")).distinct()
    spans = pick("ANAT", "start", "end", "keyword").unionByName(pick("FIND", "f_start", "f_end", "illness"))
    w = Window.partitionBy(*key).orderBy("label", "start_offset", "end_offset", "keyword")
    spans = spans.withColumn("id", F.row_number().over(w) - 1)
    of = lambda label, a, b, k, name: spans.where(F.col("label") == label).select(*key, F.col("start_offset").alias(a), F.col("end_offset").alias(b), F.col("keyword").alias(k), F.col("id").alias(name))
    pairs = base.select(*key, "start", "end", "keyword", "f_start", "f_end", "illness").distinct()
    linked = pairs.join(of("ANAT", "start", "end", "keyword", "from_id"), [*key, "start", "end", "keyword"]).join(of("FIND", "f_start", "f_end", "illness", "to_id"), [*key, "f_start", "f_end", "illness"])
    return spans.select(*key, "id", "label", "start_offset", "end_offset", "keyword"), linked.select(*key, "from_id", "to_id").distinct()


# --- the older engine's answers ---------------------------------------------------------------


def inherited_measure(text: Column) -> Column:
    """The longest length of a text in millimetres, numbers before a factor taking the unit of the next length; a metre counts as 100."""
    runs = ft.all_of(F.replace(text, F.lit("*"), F.lit("×")), "(?i)(?:[0-9]+(?:[.][0-9]+)?×)*[0-9]+(?:[.][0-9]+)?(?:mm|cm|毫米|厘米|米|m)")

    def longest(run: Column) -> Column:
        unit = F.lower(F.regexp_extract(run, "(?i)(mm|cm|毫米|厘米|米|m)$", 1))
        scale = F.when(unit.isin("cm", "厘米"), 10.0).when(unit.isin("mm", "毫米"), 1.0).otherwise(100.0)
        return F.array_max(F.transform(ft.all_of(run, "[0-9]+(?:[.][0-9]+)?"), lambda n: n.try_cast("double"))) * scale

    return F.coalesce(F.array_max(F.transform(runs, longest)), F.lit(0.0))


def in_words(values: Column, none: str, head: str) -> Column:
    """A list of findings as the older engine says it: a sentence of its own where there is none, numbered where there are several."""
    many = F.array_join(F.transform(values, lambda x, i: F.concat((i + 1).cast("string"), F.lit("."), x)), "；")
    return F.when(F.coalesce(F.size(values), F.lit(0)) == 0, none).when(F.size(values) == 1, F.concat(F.lit(head), values[0])).otherwise(F.concat(F.lit(head), many))
