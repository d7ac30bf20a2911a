"""Parties and addresses: canonical values, shared roles, exact matches to an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold


def first_non_null(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Per key, each column's first value that isn't null, in order."""
    pick = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c)
    return rows.groupBy(*keys).agg(*map(pick, columns))


def shared_roles(addresses: DataFrame) -> DataFrame:
    """The roles that use each address fingerprint; fingerprints with several."""
    return addresses.groupBy("fingerprint").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count("*").alias("n")).where(F.size("roles") > 1)


def address_key(*parts: Column) -> Column:
    """One hash of the folded parts."""
    return F.sha2(F.concat_ws("|", *(fold(p) for p in parts)), 256)


def matches(candidates: DataFrame, index: DataFrame, exact: bool) -> DataFrame:
    """Candidates whose key the index has, or (exact=False) hasn't."""
    return candidates.join(index.select("key").distinct(), "key", "left_semi" if exact else "left_anti")
