"""Revisions, logs and queues as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_revision(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """The row with the highest revision of each key: one aggregate, no sort."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), revision).alias("r"))
    return best.select("r.*")


def revision_gaps(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """Per key: first, last and number of revisions, and whether they are contiguous from 0."""
    per = rows.groupBy(key).agg(F.min(revision).alias("first"), F.max(revision).alias("last"), F.count_distinct(revision).alias("n"))
    return per.withColumn("contiguous", (F.col("first") == 0) & (F.col("last") + 1 == F.col("n")))


def first_seen(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key."""
    return events.groupBy(*keys).agg(F.min(F.struct(*order)).alias("o")).select(*keys, "o.*")


def conflicts(events: DataFrame, key: str, digest: str) -> DataFrame:
    """accepted once, duplicate (same digest) or rejected (another digest) for each key."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("digests")).withColumn("verdict", F.when(F.col("digests") > 1, "REJECTED").when(F.col("n") > 1, "DUPLICATE_IGNORED").otherwise("ACCEPTED"))


def claim(queue: DataFrame, group: str, n: int, order: list[str]) -> DataFrame:
    """The ``n`` oldest entries of each group, first in first out."""
    return queue.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def stale(queue: DataFrame, now: str, minutes: int) -> DataFrame:
    """Entries older than the limit go back to ``queued``; others are ``running``."""
    age = F.to_timestamp(F.lit(now)).cast("long") - F.col("ts").cast("timestamp").cast("long")
    return queue.withColumn("state", F.when(age > 60 * minutes, "queued").otherwise("running"))
