"""Report rows: synthetic ones from the star schema, and readers of report files.

Synthetic reports pick phrases by remainders of the order's keys, so any engine derives
identical text. ``REPORTS_SQL`` is the same projection for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures as fx

#: Column: list of (multiplier, shift, phrases); phrases are joined in order.
_PICKS = {
    "modality": [("o_orderkey", 1, 0, fx.MODALITIES)],
    "StudyPart": [("o_custkey", 3, 1, fx.EXAM)],
    "Sex": [("o_custkey", 1, 0, ("男", "女", "M", "F"))],
    "applyTable": [("o_custkey", 7, 2, tuple(f"{d}待查" for d in fx.CONCLUSION))],
}
_DESC = [("o_orderkey", 1, 0), ("o_orderkey", 5, 3), ("o_custkey", 3, 7)]
_CONC = [("o_orderkey", 1, 4), ("o_custkey", 11, 1)]


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pick(key: str, times: int, shift: int, items, duck: bool) -> str:
    at = f"CAST(({key} * {times} + {shift}) % {len(items)} AS INTEGER) + 1"
    values = ", ".join(map(_quote, items))
    return f"list_extract([{values}], {at})" if duck else f"element_at(array({values}), {at})"


def _columns(duck: bool) -> list[str]:
    out = ["o_orderkey AS report_id"]
    for name, picks in _PICKS.items():
        out.append(f"{_pick(*picks[0], duck)} AS {name}")
    for name, picks, phrases in (("ReportStr", _DESC, fx.DESCRIPTION), ("ConclusionStr", _CONC, fx.CONCLUSION)):
        parts = ", ".join(f"{_pick(*p, phrases, duck)}, '。'" for p in picks)
        out.append(f"concat({parts}) AS {name}")
    return out


def synthetic_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, modality, StudyPart, Sex, applyTable, ReportStr, ConclusionStr), one row for each order."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_columns(False))


REPORTS_SQL = f"SELECT {', '.join(_columns(True))} FROM orders"


def read_reports_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Reports from JSON lines, with a fixed schema: no inference pass over the files."""
    fields = ("report_id", "ReportStr", "ConclusionStr", "StudyPart", "Sex", "modality", "applyTable")
    return spark.read.schema(", ".join(f"{f} string" for f in fields)).json(path)


def read_corpus(spark: SparkSession, path: str, kind: str = "text", field: str = "text") -> DataFrame:
    """(text) of plain-text files (a line each), JSON lines or Parquet; path may be a glob."""
    if kind == "text":
        rows = spark.read.text(path).select(F.col("value").alias("text"))
    elif kind == "jsonl":
        rows = spark.read.schema(f"`{field}` string").json(path).select(F.col(field).alias("text"))
    elif kind == "parquet":
        rows = spark.read.parquet(path).select(F.col(field).cast("string").alias("text"))
    else:
        raise ValueError(f"kind {kind!r} is none of text, jsonl, parquet")
    return rows.where(F.length(F.trim("text")) > 0)


def read_lexicon(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Space-separated text with ``#`` comments; columns: name to type, bad numbers become null."""
    cells = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return rows.select(*(F.get(cells, F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(columns.items())))


def read_word_table(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq, pos): rows without a whole frequency are skipped, a missing part of speech is ``n``."""
    rows = read_lexicon(spark, path, {"word": "string", "freq": "bigint", "pos": "string"})
    return rows.where(F.col("freq").isNotNull()).select("word", "freq", F.coalesce("pos", F.lit("n")).alias("pos"))


def read_homophones(spark: SparkSession, path: str) -> DataFrame:
    """(char, homophone): a tab-separated character and its homophones, one row for each."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(cells) >= 2).select(cells[0].alias("char"), F.explode(F.split(cells[1], "")).alias("homophone"))
    return rows.where((F.trim("homophone") != "") & (F.col("homophone") != F.col("char"))).distinct()


def read_vocabulary(spark: SparkSession, path: str, least: int = 3, most: int = 10) -> DataFrame:
    """(word): first token of each line, with least..most characters."""
    word = F.split(F.trim("value"), "\\s+")[0]
    return spark.read.text(path).select(word.alias("word")).where(F.length("word").between(least, most)).distinct()


def read_named(spark: SparkSession, path: str, most: int = 100) -> DataFrame | None:
    """At most ``most`` rows of a table of files, in order of their first column; None where the path holds nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    rows = spark.read.parquet(path)
    return rows.orderBy(rows.columns[0]).limit(most)
