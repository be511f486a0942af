"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's rows to the shared scratch folder and reads them again as the next one's docs.
All stages but the last return the columns of ``documents``.

1. quality classifier: documents that it rejects go.
2. SimHash near-dedup: one document of each group stays, the one with the smallest id.
3. substring dedup: repeated windows of 50 words are cut out of the later documents.
4. mixing: documents are repeated or left out to meet the sources' target weights.
5. byte-level BPE: encoded and decoded; the digest columns of the operator's query.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
tables and further columns of any name; what it makes of them is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, quality, queries, simhash, substring
from tessera.llm.common import Scratch, temporary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels are learnt from the rows that the operator's query learns from.

    Null and empty texts are scored as an empty passage; with labels of one kind or none, all rows or none stay;
    repeated rows and rows without id go by their text; an empty table stays empty.
    """
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir, docs), queries.THRESHOLD)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8 or more; of each group the smallest id stays.

    Texts without words are one group; of repeated rows one stays; rows without id come after all others; equal ids
    with different texts are different documents; an empty table stays empty.
    """
    return simhash.keep_dissimilar(docs, similarity=0.8, width=5)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that start in a document of a smaller id go; a text that loses all of its words is empty.

    Null texts stay null; repeated rows of an id keep theirs; rows without id come last; an empty table stays empty.
    """
    return substring.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out as the operator's query takes them.

    A null source is a source; texts without words have size 0 and are never needed; rows that agree in id and text
    are taken equally often; an empty table stays empty.
    """
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row, repeated ones included; null and empty texts have no tokens."""
    return bpe.round_trip(docs, bpe.read_ranks(queries.RANKS), queries.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: SQL can't express the classifier, the XXH64 fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on the table documents. What a stage leaves in the shared folder goes once its rows are written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for _, stage in STAGES:
        with temporary():
            docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = [docs]
    return docs
