"""Tables that an engine query needs more than once, written below the folder that driver and executors share.

A lost executor costs the reading of its files again, never the derivation. The folder is
``spark.checkpoint.dir``; only where that isn't set and Spark runs in one process, as in
tests, a temporary folder is used.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = getattr(spark, "_tessera_tables", None)
    if path is None:
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark._tessera_tables = path
        atexit.register(lambda: shutil.rmtree(path[7:], ignore_errors=True))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released():
    """What ``stored`` writes within is removed at the end: write the results before."""
    mark = len(_made)
    try:
        yield
    finally:
        for spark, name in _made[mark:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _made[mark:]
