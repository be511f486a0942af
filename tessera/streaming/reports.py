"""Report checks on a stream; an addition to the batch queries.

The per-report rules are stateless, so a micro-batch gives the rows that a batch run
gives. Checks that relate entities of one report need the report in one micro-batch,
which holds as a report is one row. ``counts_by_window`` is the stateful example.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

REPORT = "report_id string, ReportStr string, ConclusionStr string, StudyPart string, Sex string, modality string, applyTable string"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REPORT).json(path)


def check_stream(reports: DataFrame, check: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Writes the findings of each micro-batch to its own folder below ``sink``, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, event_type, n): event counts by time, late rows up to the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
