"""Cutting lineage between rounds of a loop, and a place for files that a job reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which goes when the session ends."""
    at = f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder. On a cluster spark.checkpoint.dir must name a shared one; where all runs in one process (tests) a
    folder of our own is made."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: columns compress, and a reader takes those that it needs."""
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialised(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read again."""
    _folder(df.sparkSession)
    return df.checkpoint()
