"""Feedback events as a stream: each accepted once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def accepted_once(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first of each key within the watermark: state is dropped after it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """All that is there now, written as Parquet with a checkpoint to the shared folder, and read again."""
    spark = stream.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    top = top.rstrip("/")
    path = f"{top}/ledgerloom-stream-{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
