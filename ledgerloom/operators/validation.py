"""Arithmetic and semantic checks of orders and their lines, and the gate over what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import cents, close


def check_lines(lines: DataFrame) -> DataFrame:
    """Adds ``status``: VALID or INVALID where quantity, unit_price and line_total are all there, else null."""
    there = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("line_total").isNotNull()
    return lines.withColumn("status", F.when(there, F.when(close(F.col("quantity") * F.col("unit_price"), F.col("line_total")), "VALID").otherwise("INVALID")))


def line_sums(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Each document's product sum against its printed total; ``computed_only`` without one."""
    sums = lines.groupBy("doc_id").agg(F.sum(cents(F.col("line_total"))).alias("s"), F.count("*").alias("n_lines"))
    out = documents.select("doc_id", "total").join(sums, "doc_id")
    value = F.col("s").cast("double")
    return out.select("doc_id", "n_lines", value.alias("product_sum"), "total", F.when(F.col("total").isNull(), "computed_only").when(close(value, F.col("total")), "match").otherwise("mismatch").alias("line_sum_status"))


def duplicate_signatures(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Per document, how many line signatures (with a value in them) occur more than once."""
    some = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()
    return lines.where(some).groupBy("doc_id", *columns).agg(F.count("*").alias("n")).where("n > 1").groupBy("doc_id").agg(F.count("*").alias("duplicate_signatures"))


def number_sequence(lines: DataFrame) -> DataFrame:
    """Whether the line numbers of each document, in reading order, increase strictly; documents with two or more."""
    follows = F.lead("line_number").over(W.partitionBy("doc_id").orderBy("ix"))
    return lines.where("line_number IS NOT NULL").withColumn("follows", follows).groupBy("doc_id").agg(F.count("*").alias("n_numbers"), (F.count_if(F.col("follows") <= F.col("line_number")) == 0).alias("increasing")).where("n_numbers > 1")


def audit_lines(lines: DataFrame) -> DataFrame:
    """A row for each issue: its code, severity and path. Prices may hold for a basis of several units."""
    price = F.coalesce("net_unit_price", "unit_price")
    basis = F.when(F.coalesce("price_unit", F.lit(0.0)) == 0, 1.0).otherwise(F.col("price_unit"))
    expected = F.col("quantity") * price / basis
    allowed = F.greatest(F.lit(0.03), F.abs(F.col("quantity") / basis) * 0.005 + 0.005)
    issues = F.array_compact(
        F.array(
            F.when(F.col("quantity").isNull(), F.struct(F.lit("QUANTITY_MISSING").alias("code"), F.lit("WARN").alias("severity"))),
            F.when(price.isNull(), F.struct(F.lit("PRICE_MISSING").alias("code"), F.lit("WARN").alias("severity"))),
            F.when(F.abs(expected - F.col("line_total")) > allowed, F.struct(F.lit("LINE_ARITHMETIC").alias("code"), F.lit("ERROR").alias("severity"))),
        )
    )
    found = lines.select("doc_id", "ix", F.explode(issues).alias("i"))
    return found.select("doc_id", "i.code", "i.severity", F.concat(F.lit("lines["), F.col("ix").cast("string"), F.lit("]")).alias("path"))


def status(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "FAIL").when(warnings > 0, "WARNING").otherwise("PASS")


def validate_orders(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of checks for each document: lines, sum and status. One shuffle of the lines by document."""
    checked = check_lines(lines)
    per = checked.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("status").alias("checked"), F.count_if(F.col("status") == "VALID").alias("valid"), F.sum(cents(F.col("line_total"))).alias("s"))
    out = per.join(documents.select("doc_id", "total"), "doc_id")
    bad_sum = F.when(F.col("total").isNotNull(), (~close(F.col("s").cast("double"), F.col("total"))).cast("int")).otherwise(F.lit(0))
    bad_lines = F.col("checked") - F.col("valid")
    return out.select("doc_id", "n_lines", "checked", "valid", (F.col("valid") / F.greatest(F.lit(1), F.col("checked"))).alias("valid_ratio"), F.col("s").cast("double").alias("product_sum"), status(bad_sum, bad_lines).alias("status"))


def gate(issues: DataFrame) -> DataFrame:
    """A document's decision from its distinct issues: HUMAN_REVIEW with reasons in order, as none gives CHECKS_PASSED elsewhere."""
    return issues.dropDuplicates(["doc_id", "code", "path"]).groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("reasons"), F.count("*").alias("n_issues")).withColumn("decision", F.lit("HUMAN_REVIEW"))


def completeness(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Per document, the share of lines that have each field."""
    return lines.groupBy("doc_id").agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_ratio") for c in columns))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def separate_charges(lines: DataFrame, terms: list[str]) -> DataFrame:
    """``kind``: charge for lines whose description names one, else product."""
    found = F.lower(F.col("description")).rlike(r"\b(" + "|".join(terms) + r")\b")
    return lines.withColumn("kind", F.when(found, "charge").otherwise("product"))
