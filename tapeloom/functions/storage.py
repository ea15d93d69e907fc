"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder given to setCheckpointDir, else a local one, but only where Spark runs in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
        named = os.path.join(tempfile.gettempdir(), "tapeloom-checkpoints")
    return named.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stored-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a file of that name in a new folder among the stored tables; `discard` deletes it."""
    return f"{_root(spark)}/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors.

    All of an application's tables lie in one folder, which `discard` deletes.
    """
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes every table that `stored` has written in this application; call it when no result that was returned is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
