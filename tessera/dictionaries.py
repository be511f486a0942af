"""What a user brings along: anatomy graph, rule tables and lexicon, as values that operators take as a parameter.

The tables are small (names of body parts, a few hundred rules). They are read with
Spark, checked for size, and kept as plain rows, so that they travel with the tasks.
``DEFAULT`` holds the package's own.
"""

from __future__ import annotations

import configparser
import json
import re
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.config import LEXICON, Lexicon

#: Rows of a dictionary at most; more are refused, not dropped.
MOST = 500_000

KgRow = tuple[str, str, str, int, float, float]


@dataclass(frozen=True)
class Dictionaries:
    """kg: (name, canonical name, path, depth, lo, hi); normal: (keyword, property, least, most); critical: (number, device,
    conclusion pattern, part, least value, description pattern, category); replace: (order, pattern, replacement, is regex)."""

    kg: tuple[KgRow, ...] = field(default_factory=lambda: tuple(fx.kg_rows()))
    normal: tuple = fx.NORMAL_MEASURE
    critical: tuple = fx.CRITICAL
    replace: tuple = fx.REPLACE
    lexicon: Lexicon = LEXICON

    def names(self) -> list[str]:
        return sorted({r[0] for r in self.kg}, key=lambda a: (-len(a), a))

    def graph(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.kg), "keyword string, position string, path string, depth int, lo double, hi double")


DEFAULT = Dictionaries()


class Names:
    """Leftmost, longest names in a text, none overlapping: the next first letter, then the names that begin with it."""

    def __init__(self, names: list[str]):
        by: dict[str, list[str]] = {}
        for n in names:
            if n:
                by.setdefault(n[0], []).append(n)
        self.first = re.compile("[" + "".join(map(re.escape, by)) + "]") if by else None
        self.rest = {c: re.compile("|".join(re.escape(n) for n in sorted(ns, key=lambda n: (-len(n), n)))) for c, ns in by.items()}

    def spans(self, text: str) -> list[tuple[str, int]]:
        out, at = [], 0
        while self.first and (m := self.first.search(text, at)):
            hit = self.rest[m.group()].match(text, m.start())
            if hit:
                out.append((hit.group(), m.start()))
                at = hit.end()
            else:
                at = m.start() + 1
        return out


# --- readers ---------------------------------------------------------------------------

LEVELS = ("一级部位", "二级部位", "三级部位", "四级部位", "五级部位", "六级部位")
_PROPERTY = {"长度": "length", "百分比": "percent", "体积": "volume"}


def read_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A sheet as delimited text with a header, all cells as text; blank cells are null."""
    rows = spark.read.option("header", True).option("sep", separator).option("multiLine", True).csv(path)
    return rows.select(*(F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))).alias(c.strip()) for c in rows.columns))


def kg_nodes(rows: DataFrame) -> DataFrame:
    """(keyword, position, path, depth, lo, hi) of rows of level cells ``canonical|synonym|...`` with axis coordinates.

    Every prefix of a row is a node; a node spans the axis of its rows.
    """
    have = [c for c in LEVELS if c in rows.columns]
    cells = F.filter(F.array(*(F.col(c) for c in have)), lambda x: x.isNotNull())
    base = rows.select(cells.alias("cells"), F.col("起始坐标").try_cast("double").alias("lo"), F.col("终止坐标").try_cast("double").alias("hi")).where(F.size("cells") > 0)
    canonical = F.transform("cells", lambda c: F.trim(F.split(c, "\\|")[0]))
    base = base.withColumn("nodes", canonical)
    each = base.select("lo", "hi", "nodes", F.posexplode("cells").alias("k", "cell"))
    path = F.array_join(F.slice("nodes", F.lit(1), F.col("k") + 1), ">")
    names = F.filter(F.transform(F.split("cell", "\\|"), F.trim), lambda n: n != "")
    each = each.select("lo", "hi", path.alias("path"), (F.col("k") + 1).alias("depth"), F.get("nodes", F.col("k")).alias("position"), F.explode(names).alias("keyword"))
    span = each.groupBy("path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return each.select("keyword", "position", "path", "depth").distinct().join(span, "path").select("keyword", "position", "path", "depth", "lo", "hi")


def _rows(df: DataFrame, what: str) -> tuple[tuple, ...]:
    got = df.limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"{what}: more than {MOST} rows")
    return tuple(sorted((tuple(r) for r in got), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r)))


def read_kg(spark: SparkSession, path: str) -> tuple[KgRow, ...]:
    return _rows(kg_nodes(read_table(spark, path)), "anatomy graph")


def read_normal(spark: SparkSession, path: str) -> tuple:
    """Normal ranges: 关键词, 属性 (长度, 百分比, 体积), 最小值, 最大值."""
    t = read_table(spark, path)
    kind = F.create_map(*(F.lit(x) for kv in _PROPERTY.items() for x in kv))
    out = t.select("关键词", F.coalesce(F.try_element_at(kind, F.col("属性")), F.col("属性")).alias("p"), F.col("最小值").try_cast("double").alias("a"), F.col("最大值").try_cast("double").alias("b"))
    return _rows(out.where("`关键词` IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL"), "normal ranges")


def read_critical(spark: SparkSession, path: str) -> tuple:
    """Critical values: 序号, 设备, 结论, 部位, 描述值, 描述, 类别."""
    t = read_table(spark, path)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    out = t.select(F.col("序号").try_cast("int").alias("n"), text("设备"), text("结论"), text("部位"), F.coalesce(F.col("描述值").try_cast("double"), F.lit(0.0)).alias("least"), text("描述"), text("类别"))
    return _rows(out.where("n IS NOT NULL"), "critical values")


def read_replace(spark: SparkSession, path: str, version: str = "", modality: str = "") -> tuple:
    """Replacement rules for a version and modality (DR as DX): its own rows, else those without modality, else the package's.

    原始值, 替换值, IsRegex and, where a file holds several sheets, version and modality. Plain rules of at most four
    letters go first, then longer ones, then patterns.
    """
    t = read_table(spark, path)
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in t.columns else F.lit("")
    rows = t.select("原始值", F.coalesce(F.col("替换值"), F.lit("")).alias("new"), F.coalesce(F.lower(col("IsRegex")).isin("true", "1", "yes", "是"), F.lit(False)).alias("regex"), col("version").alias("v"), F.upper(col("modality")).alias("m")).where("`原始值` IS NOT NULL")
    want = {"DR": "DX"}.get(modality.upper(), modality.upper())
    rows = rows.where(F.col("v").isin("", version))
    for m in dict.fromkeys((want, "")):
        got = _rows(rows.where(F.col("m") == m).select("原始值", "new", "regex"), "replacement rules")
        if got:
            return ordered_rules(got)
    return fx.REPLACE


def ordered_rules(rules) -> tuple:
    """(order, pattern, replacement, is regex) of (pattern, replacement, is regex)."""
    rank = lambda r: (2 if r[2] else 0 if len(r[0]) <= 4 else 1)
    return tuple((k, *r) for k, r in enumerate(sorted(rules, key=lambda r: (rank(r), -len(r[0]), r[0]))))


def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def read_ini(path: str) -> dict[str, dict[str, str]]:
    """Sections of an ini file, read on the driver; values are taken as they are."""
    parser = configparser.RawConfigParser(strict=False)
    parser.optionxform = str
    parser.read(path, encoding="utf-8")
    return {s: dict(parser.items(s)) for s in parser.sections()}


def read_lexicon_ini(path: str, base: Lexicon = LEXICON) -> Lexicon:
    """``base`` with the values that an ini file gives for its fields, in any section; numbers are numbers, patterns must compile."""
    given = {k: v for section in read_ini(path).values() for k, v in section.items()}
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    out = {k: kinds[k](v.strip()) for k, v in given.items() if k in kinds}
    bad = [k for k, v in out.items() if isinstance(v, str) and not valid_pattern(v)]
    if bad:
        raise ValueError(f"not a pattern: {', '.join(bad)}")
    return replace(base, **out)


def read_env(path: str) -> dict[str, str]:
    """key=value lines; blank lines and those that start with # are left out, quotes around values go."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                out[key.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return out


def thresholds(defaults: dict[str, float], markdown: str | None = None, env: dict[str, str] | None = None, prefix: str = "TESSERA_") -> dict[str, float]:
    """Defaults, over them the JSON object after ``best=`` in a Markdown file, over those variables of the environment.

    Names that the defaults lack, and values that are no numbers, are left out.
    """
    out = dict(defaults)
    if markdown is not None:
        with open(markdown, encoding="utf-8") as f:
            found = re.search(r"best\s*=\s*(\{.*?\})", f.read(), re.S)
        try:
            given = json.loads(found[1]) if found else {}
        except ValueError:
            given = {}
        out |= {k: float(v) for k, v in given.items() if k in out and isinstance(v, int | float)}
    for k in out:
        value = (env or {}).get(prefix + k.upper(), "")
        if re.fullmatch(r"\s*-?\d+(\.\d+)?\s*", value):
            out[k] = float(value)
    return out


def read_segmenter(spark: SparkSession, user: str, general: str, least: int = 1000, most: int = 10_000) -> list[str]:
    """Words for the segmenter, the longest first: all of a user's, and of a general list (word, frequency) the first ``most`` in file order that are frequent and of two letters or more."""
    token = F.split(F.trim("value"), "\\s+")
    own = spark.read.text(user).select(token[0].alias("word")).where("word <> ''")
    lines = spark.read.text(general, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    words = lines.select("line", token[0].alias("word"), F.get(token, F.lit(1)).try_cast("long").alias("freq")).where(f"freq > {least} AND length(word) >= 2").orderBy("line").limit(most)
    return sorted({r["word"] for r in _collected(own, "user words") + words.select("word").collect()}, key=lambda w: (-len(w), w))


def _collected(df: DataFrame, what: str) -> list:
    got = df.distinct().limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"{what}: more than {MOST} rows")
    return got


def read_special(spark: SparkSession, path: str) -> dict[str, dict[str, tuple[str, ...]]]:
    """Special exams by group and exam: the words by which an order asks for each. 一级项目, 二级项目, 三级项目; blank cells take the one above."""
    rows = [r.asDict() for r in _collected(read_table(spark, path).withColumn("n", F.monotonically_increasing_id()), "special exams")]
    out: dict[str, dict[str, list[str]]] = {}
    group = exam = ""
    for r in sorted(rows, key=lambda r: r["n"]):
        if r["一级项目"]:
            group, exam = r["一级项目"], ""
        exam = r["二级项目"] or exam
        if r["三级项目"]:
            out.setdefault(group, {}).setdefault(exam, []).extend(w for w in r["三级项目"].split("|") if w)
    return {g: {e: tuple(dict.fromkeys(ws)) for e, ws in es.items()} for g, es in out.items()}


def load(spark: SparkSession, kg: str | None = None, normal: str | None = None, critical: str | None = None, rules: str | None = None, ini: str | None = None, version: str = "", modality: str = "") -> Dictionaries:
    """Dictionaries from files; what isn't given is the package's."""
    d = DEFAULT
    return Dictionaries(
        read_kg(spark, kg) if kg else d.kg,
        read_normal(spark, normal) if normal else d.normal,
        read_critical(spark, critical) if critical else d.critical,
        read_replace(spark, rules, version, modality) if rules else d.replace,
        read_lexicon_ini(ini) if ini else d.lexicon,
    )


def save(d: Dictionaries, spark: SparkSession, path: str) -> None:
    """The graph and the rule tables as Parquet, one folder each."""
    d.graph(spark).write.mode("overwrite").parquet(f"{path}/kg")
    for name, rows, schema in (
        ("normal", d.normal, "keyword string, property string, least double, most double"),
        ("critical", d.critical, "number int, device string, pattern string, part string, least double, described string, category string"),
        ("replace", d.replace, "step int, pattern string, replacement string, regex boolean"),
    ):
        spark.createDataFrame(list(rows), schema).write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str) -> Dictionaries:
    """What ``save`` wrote."""
    read = lambda n: _rows(spark.read.parquet(f"{path}/{n}"), n)
    return replace(DEFAULT, kg=read("kg"), normal=read("normal"), critical=read("critical"), replace=read("replace"))


def cleaned(text: Column, rules: tuple) -> Column:
    """text after the replacement rules, in their order."""
    for _, pattern, new, regex in sorted(rules):
        text = F.regexp_replace(text, pattern, new) if regex else F.replace(text, F.lit(pattern), F.lit(new))
    return text
