"""Which texts hold which passages, found by runs of words instead of comparing each with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run; a passage needs two more, as its first and last may be parts of a text's words.
RUN = 4
#: So many short passages are broadcast.
SHORT = 2000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _runs(words: Column, last: Column) -> Column:
    """Hashes of the runs of words 1 to ``last``; no array if there is none."""
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(RUN))))


def holds(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) where ``texts(doc_id, text)`` contains ``passages(item_id, passage)``; doc_id is unique.

    A passage's words 2 to 5 stand whole in any text that holds it, so the two sides meet by their hash: an equi-join of
    two narrow tables, which Spark broadcasts or shuffles by size. Only texts that met a passage are read again and
    compared exactly. Passages of fewer than six words are compared with every text if they are few, else with texts that have their first characters; null matches nothing, the empty passage everything.
    """
    worded = passages.where("passage IS NOT NULL").withColumn("w", _words(F.col("passage")))
    long, short = worded.where(F.size("w") >= RUN + 2), worded.where(F.size("w") < RUN + 2)
    anchors = long.select("item_id", F.xxhash64(F.slice("w", 2, RUN)).alias("run"))
    split = texts.select("doc_id", _words(F.col("text")).alias("w")).where(F.size("w") >= RUN)
    runs = split.select("doc_id", F.explode(F.array_distinct(_runs(F.col("w"), F.size("w") - RUN + 1))).alias("run"))
    met = runs.join(anchors, "run").select("doc_id", "item_id").distinct().join(long.select("item_id", "passage"), "item_id")
    found = texts.select("doc_id", "text").join(met, "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
    return found.unionByName(_short(texts.select("doc_id", "text"), short.select("item_id", "passage")))


def _short(texts: DataFrame, short: DataFrame) -> DataFrame:
    """As ``holds``, for passages without a whole run: compared with every text while they are counted to be few, else only where a text has their first three characters."""
    within = F.contains(F.col("text"), F.col("passage"))
    if short.count() <= SHORT:
        return texts.join(F.broadcast(short), within).select("doc_id", "item_id")
    tiny, rest = short.where(F.length("passage") < 3), short.where(F.length("passage") >= 3)
    n = F.length("text")
    grams = F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col("text"), i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    met = texts.select("doc_id", F.explode(grams).alias("gram")).join(rest.select("item_id", "passage", F.substring("passage", 1, 3).alias("gram")), "gram").select("doc_id", "item_id", "passage")
    found = texts.join(met, "doc_id").where(within).select("doc_id", "item_id")
    # of one or two characters there are few different passages, however many rows
    kinds = texts.join(F.broadcast(tiny.select("passage").distinct()), within).select("doc_id", "passage")
    return found.unionByName(kinds.join(tiny, "passage").select("doc_id", "item_id"))
