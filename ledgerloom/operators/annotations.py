"""Annotated fields of documents: their paths, order and conflicts; varied samples of documents to annotate.

Fields are rows of doc_id, ix, label, path; regions add page and a box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import box, overlaps
from ..functions.judgements import ladder
from ..functions.text import field_value


def line_index(path: Column) -> Column:
    """The index of a line's path, ``lines[3].x`` or ``line_items[3].x``; null for others."""
    return F.nullif(F.regexp_extract(path, r"(?:^|[.])(?:line_items|lines)\[([0-9]+)\]", 1), F.lit("")).cast("int")


def charge_index(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:^|[.])additional_charges\[([0-9]+)\]", 1), F.lit("")).cast("int")


def structure_faults(fields: DataFrame) -> DataFrame:
    """(doc_id, fault, n): labels and paths that don't belong together, line indexes that don't run from 0, labels that stand twice (in a line, or in the document)."""
    line, charge = line_index(F.col("path")), charge_index(F.col("path"))
    of_line, of_charge = F.startswith(F.col("label"), F.lit("LINE_ITEM_")), F.startswith(F.col("label"), F.lit("CHARGE_"))
    rows = fields.withColumns({"line": line, "charge": charge, "of_line": of_line, "of_charge": of_charge})
    n = F.count_if
    loose = rows.groupBy("doc_id").agg(
        n(F.col("of_line") & F.col("line").isNull()).alias("line label outside lines"), n(~F.col("of_line") & F.col("line").isNotNull()).alias("other label in a line"), n(F.col("of_charge") & F.col("charge").isNull()).alias("charge label outside charges"),
        n(~F.col("of_charge") & F.col("charge").isNotNull()).alias("other label in a charge"), (F.coalesce(F.max("line") + 1, F.lit(0)) - F.count_distinct("line")).alias("missing line indexes"),
    )
    where = F.when(F.col("of_line"), F.concat(F.lit("l"), F.col("line").cast("string"))).when(F.col("of_charge"), F.concat(F.lit("c"), F.col("charge").cast("string")))
    twice = rows.groupBy("doc_id", "label", F.coalesce(where, F.lit("")).alias("where")).agg((F.count("*") - 1).alias("more")).groupBy("doc_id").agg(F.sum("more").alias("duplicate labels"))
    names = [c for c in loose.columns if c != "doc_id"] + ["duplicate labels"]
    faults = F.array(*(F.struct(F.lit(c).alias("fault"), F.col(f"`{c}`").cast("long").alias("n")) for c in names))
    return loose.join(twice, "doc_id").select("doc_id", F.explode(F.filter(faults, lambda f: f["n"] > 0)).alias("f")).select("doc_id", "f.*")


def lines_last(fields: DataFrame) -> DataFrame:
    """Adds ``place``: other fields in their order, then those of lines by line and order."""
    line = line_index(F.col("path"))
    order = W.partitionBy("doc_id").orderBy(line.isNotNull(), line, "ix")
    return fields.withColumn("place", F.row_number().over(order) - 1)


def compact_lines(fields: DataFrame) -> DataFrame:
    """Paths with line indexes that run from 0 without gaps."""
    line = line_index(F.col("path"))
    rows = fields.withColumn("_line", line)
    dense = F.dense_rank().over(W.partitionBy("doc_id", F.col("_line").isNull()).orderBy("_line")) - 1
    rows = rows.withColumn("_new", dense.cast("string"))
    head, tail = F.regexp_extract("path", r"^(.*?)(?:line_items|lines)\[[0-9]+\](.*)$", 1), F.regexp_extract("path", r"^(.*?)(?:line_items|lines)\[[0-9]+\](.*)$", 2)
    return rows.withColumn("path", F.when(F.col("_line").isNotNull(), F.concat(head, F.lit("line_items["), F.col("_new"), F.lit("]"), tail)).otherwise(F.col("path"))).drop("_line", "_new")


def region_conflicts(fields: DataFrame) -> DataFrame:
    """(doc_id, page, a, b, code): pairs of regions of a page that overlap under different labels; with one text the label is ambiguous, else the boxes cross. Fields have ix, label, text, x0 to y1."""
    a = fields.select("doc_id", "page", F.col("ix").alias("a"), F.col("label").alias("la"), F.col("text").alias("ta"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = fields.select("doc_id", "page", F.col("ix").alias("b"), F.col("label").alias("lb"), F.col("text").alias("tb"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = a.join(b, ["doc_id", "page"]).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & overlaps(box("a_"), box("b_")))
    same = field_value(F.col("ta")) == field_value(F.col("tb"))
    return pairs.select("doc_id", "page", "a", "b", F.when(same, "AMBIGUOUS_LABEL").otherwise("CROSSING_REGIONS").alias("code"))


def new_conflicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Conflicts (doc_id, page, a, b, code) that a change adds."""
    return after.join(before, ["doc_id", "page", "a", "b", "code"], "left_anti")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Of candidates (doc_id, ix, grp, label, value, exact, evidence, confidence) the best of each group, label and value, in the place of the first."""
    key = ["doc_id", "grp", "label", field_value(F.col("value")).alias("_v")]
    better = F.struct(F.col("exact").cast("int"), F.col("evidence").cast("int"), "confidence", -F.col("ix"))
    per = candidates.groupBy(*key).agg(F.max_by(F.struct("ix", "value", "confidence"), better).alias("b"), F.min("ix").alias("place"))
    return per.select("doc_id", "grp", "label", "place", F.col("b.ix").alias("ix"), F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"))


def page_bucket(n: Column) -> Column:
    return ladder((n <= 1, "1"), (n <= 3, "2-3"), otherwise="4+")


def varied(candidates: DataFrame, count: int, seed: str) -> DataFrame:
    """``count`` documents (doc_id, family, stratum, digest) that balance families, then strata in a family, each content once, in an order that the seed fixes.

    Every family is taken from in turn, and in a family every stratum in turn: a window for each, so no task sees more than a family. At most ``count`` of a family can be chosen,
    which bounds what is ordered at the end.
    """
    rank = F.sha2(F.concat(F.lit(seed + "\u0000"), F.col("doc_id").cast("string")), 256)
    once = candidates.withColumn("rank", rank).groupBy("digest").agg(F.min_by(F.struct("doc_id", "family", "stratum", "rank"), "rank").alias("c")).select("c.*")
    rows = once.withColumn("_s", F.row_number().over(W.partitionBy("family", "stratum").orderBy("rank"))).where(F.col("_s") <= count)
    rows = rows.withColumn("_f", F.row_number().over(W.partitionBy("family").orderBy("_s", "rank"))).where(F.col("_f") <= count)
    return rows.orderBy("_f", "_s", "rank").limit(count).select("doc_id", "family", "stratum")


def rename_plan(documents: DataFrame) -> DataFrame:
    """(doc_id, verdict, name): names with their client's prefix; those that have it, lack a client or would clash are skipped, with why. Documents have doc_id, name, client."""
    prefix = F.concat(F.trim("client"), F.lit("_"))
    rows = documents.withColumn("_new", F.concat(prefix, F.col("name")))
    clash = F.count("*").over(W.partitionBy("_new")) > 1
    verdict = ladder((F.coalesce(F.trim("client"), F.lit("")) == "", "NO_CLIENT"), (F.startswith("name", prefix), "ALREADY_PREFIXED"), (F.col("_clash"), "CLASH"), otherwise="RENAME")
    return rows.withColumn("_clash", clash).select("doc_id", verdict.alias("verdict"), F.when(verdict == "RENAME", F.col("_new")).otherwise(F.col("name")).alias("name"))
