"""Shared storage for intermediate tables: written once, read by any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def workspace(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the context's checkpoint folder; an own one only in local mode, as in tests."""
    global _own
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    context = spark.sparkContext
    if configured := context.getCheckpointDir():
        return configured.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the workspace and read again: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialise`` wrote and nobody needs any more."""
    for df in tables:
        if path := getattr(df, "_ledgerloom_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
