"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame


def folder(spark) -> str:
    """spark.checkpoint.dir of the session; a local folder only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file:///tmp/tidemark-checkpoints"
    return found.rstrip("/")


def fresh(spark, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that later steps read; cuts the lineage and survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a ``written`` DataFrame, once all that reads it is written too."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that Python gets where rows are long texts.
BATCH = 4 << 20


@contextmanager
def small_batches(spark):
    """Within it, Python gets rows in Arrow batches of at most about ``BATCH`` bytes; Spark's own limit is of rows, however long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(BATCH, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)
