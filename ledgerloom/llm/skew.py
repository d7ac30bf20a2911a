"""Joins whose hot keys don't meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: A key with more than this share of the rows is hot; so there are at most 1 / SHARE of them, and they are broadcast.
SHARE, LEAST = 0.005, 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join to ``table``, which has each ``key`` once and in ``n`` how many of the ``total`` rows have it.

    Rows of hot keys meet a broadcast of at most ``1 / SHARE`` rows, all others a shuffle.
    """
    most = max(LEAST, int(total * SHARE))
    hot = materialise(table.where(F.col("n") > most), "hot")
    if not hot.limit(1).count():
        return rows.join(table.drop("n"), key)
    cool = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col("n") <= most).drop("n"), key)
    return cool.unionByName(rows.join(F.broadcast(hot.drop("n")), key).select(*cool.columns))
