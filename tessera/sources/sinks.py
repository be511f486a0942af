"""Sinks: JSON lines, JSON with statistics, tables by error type, Markdown, annotation export, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_error(df: DataFrame, path: str, column: str = "error_type") -> None:
    """One folder for each error type, in place of one sheet each."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_with_statistics(findings: DataFrame, path: str, column: str = "error_category") -> None:
    """Findings as JSON lines, a folder for each category, and beside them their numbers by category and in all."""
    findings.write.mode("overwrite").partitionBy(column).json(f"{path}/findings")
    findings.rollup(column).agg(F.count("*").alias("count")).coalesce(1).write.mode("overwrite").json(f"{path}/statistics")


def markdown_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a Markdown table line for each row; bars in cells are escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\\|", "\\\\|") for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def annotation_json(entities: DataFrame, spans: DataFrame, relations: DataFrame) -> DataFrame:
    """(json): a sentence with its spans and relations, as an annotation tool reads it. spans, relations: of ``texts.annotations``."""
    key = ["report_id", "field", "sentence_index"]
    span = F.struct("id", "start_offset", "end_offset", "label", "keyword")
    link = F.struct("from_id", "to_id", F.lit("ANAT-FIND").alias("type"))
    texts = entities.select(*key, F.col("sentence").alias("text")).distinct()
    out = texts.join(spans.groupBy(*key).agg(F.sort_array(F.collect_list(span)).alias("entities")), key).join(relations.groupBy(*key).agg(F.sort_array(F.collect_list(link)).alias("relations")), key)
    return out.select(F.to_json(F.struct("text", "entities", "relations")).alias("json"))


def html_rows(findings: DataFrame, text: str = "sentence", phrase: str = "phrase") -> DataFrame:
    """findings plus ``html``: the sentence, escaped, with the phrase marked."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = F.concat(F.lit("<mark>"), escape(F.col(phrase)), F.lit("</mark>"))
    return findings.withColumn("html", F.replace(escape(F.col(text)), escape(F.col(phrase)), mark))
