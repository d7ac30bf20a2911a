"""Product references: the shapes of a master list, and how well a reference fits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nature, reference_key, signature

#: Weight and saturation of each kind of support.
SUPPORTS = {"length": (0.14, 200), "nature": (0.06, 200), "length_nature": (0.12, 150), "signature": (0.18, 100), "p1": (0.05, 150), "p2": (0.18, 100), "p3": (0.19, 30)}


def shapes(refs: DataFrame) -> DataFrame:
    """The distinct normal references with the key of each kind of support."""
    k = reference_key(F.col("ref"))
    out = refs.select(k.alias("key")).where("key <> ''").distinct()
    n, size = nature(F.col("key")), F.length("key").cast("string")
    prefix = lambda i: F.concat(F.substring("key", 1, i), F.lit("@"), size)
    return out.select("key", size.alias("length"), n.alias("nature"), F.concat(size, F.lit(":"), n).alias("length_nature"), signature(F.col("key")).alias("signature"), prefix(1).alias("p1"), prefix(2).alias("p2"), prefix(3).alias("p3"))


def profile(refs: DataFrame, least: int = 2) -> DataFrame:
    """(kind, value, n): how many distinct references support each value; prefixes from ``least`` on."""
    long = shapes(refs).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in SUPPORTS))).alias("x")).select("x.*")
    return long.groupBy("kind", "value").agg(F.count("*").alias("n")).where((F.col("n") >= least) | ~F.col("kind").isin("p1", "p2", "p3"))


def support(n: Column, saturation: int) -> Column:
    """Grows with the logarithm of the count, up to 1 at the saturation."""
    return F.least(F.lit(1.0), F.log1p(n) / F.log1p(F.lit(float(max(2, saturation)))))


def score(refs: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, score, supported) of each distinct reference; ``counts`` is a profile, a few thousand rows."""
    long = shapes(refs).select("key", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), F.lit(w).alias("w"), F.lit(s).alias("s")) for k, (w, s) in SUPPORTS.items()))).alias("x")).select("key", "x.*")
    part = F.col("w") * F.least(F.lit(1.0), F.log1p(F.coalesce("n", F.lit(0))) / F.log1p(F.col("s").cast("double")))
    valid = F.col("key").rlike("[0-9]") & F.length("key").between(4, 30) & (~F.col("key").rlike("^[0-9]+$") | (F.length("key") >= 7))
    total = F.round(F.when(valid, 0.08).otherwise(0.0) + F.sum(part), 6)
    return long.join(counts, ["kind", "value"], "left").groupBy("key").agg(total.alias("score")).withColumn("supported", valid & (F.col("score") >= 0.74))
