"""Answers of a model that are kept across runs: what was asked once isn't asked again.

A store is a folder with a subfolder for each run that asked something, written as Parquet and
finished by Spark's marker of success. Only finished subfolders are read, so a run that fails
leaves no half answers; runs at the same time write apart, and of two answers to one question
the earlier one holds (then that of the smaller run). What a model couldn't answer (a null
verdict) isn't kept and is asked again.

A question is known by SHA-256 of the model's name, the version of its prompt and the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = "key string, is_valid boolean, confidence double, reason string, answered_at timestamp, run string"
#: Questions in one call.
CALL = 32

Model = Callable[[pd.DataFrame], pd.DataFrame]


def question_key(text: Column, model: str, version: str) -> Column:
    parts = [F.lit(model), F.lit(version), F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _runs(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(str(s.getPath().toString()) for s in fs.listStatus(at) if s.isDirectory() and fs.exists(done(s.getPath().toString() + "/_SUCCESS")))

    def answers(self) -> DataFrame:
        """(key, is_valid, confidence, reason): one answer a key."""
        runs = self._runs()
        rows = self.spark.read.schema(KEPT).parquet(*runs) if runs else self.spark.createDataFrame([], KEPT)
        first = F.min_by(F.struct("is_valid", "confidence", "reason"), F.struct("answered_at", "run")).alias("a")
        return rows.groupBy("key").agg(first).select("key", "a.*")

    def add(self, told: DataFrame) -> None:
        """Keep (key, is_valid, confidence, reason) as one run, all of it or nothing."""
        run = uuid.uuid4().hex
        rows = told.where("is_valid IS NOT NULL").select("key", "is_valid", F.col("confidence").cast("double").alias("confidence"), "reason", F.current_timestamp().alias("answered_at"), F.lit(run).alias("run"))
        rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/run-{run}")

    def compact(self) -> None:
        """Write all answers as one run, then remove the runs that it holds; a reader in between sees both, which is the same."""
        old = self._runs()
        if len(old) < 2:
            return
        rows = self.spark.read.schema(KEPT).parquet(*old)
        first = F.min_by(F.struct(*(F.col(c) for c in rows.columns)), F.struct("answered_at", "run")).alias("a")
        rows.groupBy("key").agg(first).select("a.*").write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")
        for p in old:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def told(findings: DataFrame, store: Store, model: Model, name: str, version: str, text: str = "phrase") -> DataFrame:
    """findings plus (is_valid, confidence, reason): kept answers, and those of the model to what the store lacks, which it then keeps.

    model gets (phrase) and returns (phrase, is_valid, confidence, reason), ``CALL`` questions at a time; equal texts are asked once.
    """
    asked = findings.select(F.coalesce(text, F.lit("")).alias("phrase")).distinct().withColumn("key", question_key(F.col("phrase"), name, version))
    new = asked.join(store.answers(), "key", "left_anti").select("phrase")

    def f(batches):
        for b in batches:
            for k in range(0, len(b), CALL):
                yield model(b[k : k + CALL])[["phrase", "is_valid", "confidence", "reason"]]

    fresh = new.mapInPandas(f, "phrase string, is_valid boolean, confidence double, reason string")
    store.add(fresh.withColumn("key", question_key(F.col("phrase"), name, version)))
    known = asked.join(store.answers(), "key").drop("key").withColumnRenamed("phrase", "asked_")
    return findings.join(known, F.coalesce(findings[text], F.lit("")) == known["asked_"], "left").drop("asked_")
