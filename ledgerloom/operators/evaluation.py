"""Splits, samples and extraction quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_split(docs: DataFrame, policy: str = "v1", share: float = 0.15) -> DataFrame:
    """test, validation or train by a hash's share: no global sort, stable as documents are added."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(policy + ":"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return docs.select("doc_id", F.when(u < share, "test").when(u < 2 * share, "validation").otherwise("train").alias("split"))


def stratified(docs: DataFrame, stratum: str, n: int) -> DataFrame:
    """``n`` documents of each stratum by hash order, equal contents once."""
    digest = F.sha2(F.col("text"), 256)
    once = docs.select("doc_id", stratum, digest.alias("digest")).groupBy(stratum, "digest").agg(F.min("doc_id").alias("doc_id"))
    order = W.partitionBy(stratum).orderBy(F.sha2(F.col("doc_id").cast("string"), 256))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("digest")


def classification(pairs: DataFrame, outside: str = "O") -> DataFrame:
    """Support, precision, recall and F1 of each label of (truth, prediction) except ``outside``."""
    long = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("prediction")).cast("int").alias("hit")), F.struct(F.col("prediction").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    per = long.where(F.col("label") != outside).groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hits"))
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    return per.select("label", "support", precision.alias("precision"), recall.alias("recall"), F.when(F.col("hits") > 0, 2.0 * F.col("hits") / (F.col("predicted") + F.col("support"))).otherwise(0.0).alias("f1"))


def macro(report: DataFrame) -> DataFrame:
    """Mean F1 of labels with support, and their number."""
    return report.where("support > 0").agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.count("*").alias("labels"))


def token_f1(pairs: DataFrame) -> DataFrame:
    """F1 of the multisets of words of (id, prediction, reference)."""
    side = lambda c: pairs.select("id", F.explode(F.split(F.trim(F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", " ")), " ")).alias("w")).where("w <> ''").groupBy("id", "w").agg(F.count("*").alias("n"))
    both = side("prediction").select("id", "w", F.col("n").alias("p"), F.lit(0).alias("r")).unionByName(side("reference").select("id", "w", F.lit(0).alias("p"), F.col("n").alias("r")))
    per = both.groupBy("id", "w").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    return per.groupBy("id").agg((2.0 * F.sum(F.least("p", "r")) / (F.sum("p") + F.sum("r"))).alias("f1"))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """ADDED, REMOVED, CHANGED or SAME for each key of two runs (key, value)."""
    a, b = before.select("key", F.col("value").alias("old")), after.select("key", F.col("value").alias("new"))
    return a.join(b, "key", "full").withColumn("verdict", F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") == F.col("new"), "SAME").otherwise("CHANGED"))
