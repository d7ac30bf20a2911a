"""Competing readings of a document's lines: how complete and coherent each is, how it meets the printed total, and the one that wins.

A reading is the lines of one (doc_id, hyp): material, description, quantity, unit_price, net_unit_price, line_total, raw_text, and of its reference
the status and score. Lines are judged where they are read and sent once, by document, as one number of marks and two amounts; they are aggregated
there by (doc_id, hyp), and all else works on a row a reading in the same partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.judgements import FEE_WORDS, any_of, date_like, fee_kind, may_hold, words_in
from ..functions.money import cents
from ..functions.text import fold, fold_spaces

#: What a reading's method adds to its score (fixed values).
SOURCE_BONUS = {
    "current": 0.0, "native_table": 0.18, "geometry": 0.08, "receipt_date": 0.27, "amount_only": 0.11, "quantity_first": 0.12, "price_then_quantity": 0.14, "two_row": 0.16,
    "semantic_text": 0.20, "vertical": 0.18, "layout": 0.18, "dual_discount": 0.22, "piece_suffix": 0.18, "material_quantity_unit": 0.18, "material_split": 0.24, "material_numeric": 0.22,
}
#: Text that shows a line to be no product; statuses of references that speak against a reading.
NOISE = ("siret", "no tva", "capital de", "conditions generales", "page ")
FOOTERS = ("poids", "total hors", "total ht", "reglement")
#: A word of each of these and of each fee; a line with none of them is no noise.
NOISE_WORDS = (*FEE_WORDS, "siret", "tva", "capital", "conditions", "page", "poids", "total", "reglement")
SEVERE = ("ALPHA_ONLY", "TEXT_CAPTURE")


def total_fit(total: Column, target: Column, with_amount: Column, n: Column) -> Column:
    """Bonus or penalty for how the sum of lines and charges meets the printed net total, by the share of lines that have an amount."""
    share = with_amount / F.greatest(n, F.lit(1))
    error = F.abs(total - target) / F.greatest(F.abs(target), F.lit(1e-9))
    value = F.when(meets(total, target), 0.42).when((total >= 0) & (total < target), -0.38 * (1 - total / target)).otherwise(-F.least(F.lit(0.38), 0.24 * error))
    return F.coalesce(F.when((target > 0) & (share >= 0.8), value * share), F.lit(0.0))


def meets(total: Column, target: Column) -> Column:
    return F.abs(total - target) <= F.greatest(F.lit(0.03), F.abs(target) * 0.005)


def measures(lines: DataFrame, charges: DataFrame | None = None) -> DataFrame:
    """The counts of each reading that its quality and score are made of; with ``charges``, their number and sum."""
    c = F.col
    texts = {f.name for f in lines.schema if isinstance(f.dataType, StringType)}
    there = lambda x: F.coalesce(c(x), F.lit("")) != "" if x in texts else c(x).isNotNull()
    core = ("material", "description", "quantity", "unit_price", "line_total")
    material = F.trim(F.coalesce("material", F.lit("")))
    price = F.coalesce("net_unit_price", "unit_price")
    seen = c("quantity").isNotNull() & price.isNotNull() & c("line_total").isNotNull()
    gross = c("quantity") * c("unit_price")
    checked = gross.isNotNull() & c("line_total").isNotNull()
    amount = F.coalesce("line_total", c("quantity") * price).cast("decimal(18,6)")
    whole, printed = F.concat_ws(" ", "material", "description", "raw_text"), F.concat_ws(" ", "description", "raw_text")
    noise = F.when(may_hold(whole, NOISE_WORDS), F.when(fee_kind(whole).isNotNull() | any_of(fold_spaces(whole), NOISE), 4).otherwise(0) + F.when(words_in(fold(printed), FOOTERS), 3).otherwise(0)).otherwise(0) + F.when(date_like(material), 4).otherwise(0)
    assessed = (F.length(F.trim(F.coalesce("description", F.lit("")))) >= 2) & F.coalesce("quantity", "unit_price", "line_total").isNotNull()
    status = F.coalesce("reference_status", F.lit("MISSING"))
    eligible = assessed & (status != "MISSING")
    supported = eligible & (status == "SUPPORTED") & (c("reference_score") >= 0.74)
    flags = {
        "described": there("description") & c("description").rlike(r"\p{L}"), "coded": (material != "") & (F.length(material) <= 48) & ~material.rlike(" [^ ]+ "), "fragments": F.coalesce("quantity", "unit_price", "line_total").isNull(),
        "seen": seen, "good": seen & (F.abs(c("quantity") * price - c("line_total")) <= F.greatest(F.lit(0.03), F.abs("line_total") * 0.01)), "checked": checked, "exact": checked & (F.abs(gross - c("line_total")) <= F.greatest(F.lit(0.04), F.abs(gross) * 0.006)),
        "with_amount": F.coalesce("line_total", c("quantity") * price).isNotNull(), "assessed": assessed, "eligible": eligible, "supported": supported, "severe": assessed & status.isin(*SEVERE), "atypical": assessed & (status == "ATYPICAL"),
    }
    # small numbers of a line, in bits above the flags': core fields that it has, absurd numbers, quarters of noise
    counts = {"core": (sum((there(x).cast("int") for x in core), F.lit(0)), 3), "absurd": (sum((F.coalesce(F.abs(c(x)) > 1e9, F.lit(False)).cast("int") for x in ("quantity", "unit_price", "line_total")), F.lit(0)), 2), "noise": (noise, 4)}
    marks = sum((F.when(v, 1 << i).otherwise(0) for i, v in enumerate(flags.values())), F.lit(0))
    flag = {k: c("_marks").bitwiseAND(1 << i) != 0 for i, k in enumerate(flags)}
    at, number = len(flags), {}
    for k, (value, bits) in counts.items():
        marks = marks + value * (1 << at)
        number[k] = F.shiftright(c("_marks"), at).bitwiseAND((1 << bits) - 1)
        at += bits
    none = lambda kind: F.lit(None).cast(kind)
    rows = lines.select("doc_id", "hyp", marks.alias("_marks"), amount.alias("_amount"), F.when(supported, c("reference_score")).alias("_support"))
    if charges is not None:  # sent along, as readings of no line; a null key is none's
        rows = rows.withColumns({"_charge": none("decimal(18,2)"), "_paid": F.lit(False)}).unionByName(charges.where("doc_id IS NOT NULL AND hyp IS NOT NULL").select("doc_id", "hyp", none("int").alias("_marks"), none("decimal(18,6)").alias("_amount"), none("double").alias("_support"), cents(c("amount")).alias("_charge"), F.lit(True).alias("_paid")))
    n, zero = F.count_if, F.lit(0.0)
    paid = [] if charges is None else [n("_paid").alias("charges"), F.coalesce(F.sum("_charge").cast("double"), zero).alias("charge_sum")]
    return rows.repartition("doc_id").groupBy("doc_id", "hyp").agg(
        F.count("_marks").alias("n"), F.avg(number["core"] / len(core)).alias("complete"), *(n(v).alias(k) for k, v in flag.items()), F.sum(number["absurd"]).alias("absurd"), (F.sum(number["noise"]) / 4).alias("noise"),
        F.coalesce(F.sum("_amount").cast("double"), zero).alias("line_sum"), F.coalesce(F.avg("_support"), zero).alias("support"), *paid,
    ).where("n > 0")


def set_quality() -> Column:
    """Quality of a reading by itself, over the columns of ``measures``."""
    c, n = F.col, F.col("n")
    arithmetic = F.when(c("seen") > 0, 0.45 * c("good") / c("seen") - 0.55 * (c("seen") - c("good")) / c("seen")).otherwise(0.0)
    crowd = F.when(n > 12, F.least(F.lit(0.75), (n - 12) * 0.055)).otherwise(0.0)
    return 1.25 * c("complete") + 0.22 * c("described") / n + 0.15 * c("coded") / n + F.least(n, F.lit(8)) * 0.025 - 0.45 * c("fragments") / n - F.least(F.lit(0.8), c("absurd") * 0.18) + arithmetic - crowd


def score(lines: DataFrame, charges: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, hyp) with the parts of the score and the score; ``charges`` has doc_id, hyp, amount, ``targets`` doc_id, target."""
    c = F.col
    per = measures(lines, charges).select(
        "doc_id", "hyp", "n", "complete", "with_amount", "noise", "supported", "charges", (c("line_sum") + c("charge_sum")).alias("total"), set_quality().alias("quality"), F.when(c("checked") > 0, c("exact") / c("checked")).otherwise(0.55).alias("arith"),
        (F.when(c("eligible") > 0, 0.14 * c("supported") / c("eligible") * c("support")).otherwise(0.0) - 0.18 * (c("severe") + 0.25 * c("atypical")) / F.greatest(c("assessed"), F.lit(1))).alias("pattern"),
    )
    per = per.join(targets.select("doc_id", "target"), "doc_id", "left")
    per = per.withColumns({"coverage": c("n") / F.max("n").over(W.partitionBy("doc_id")), "total_fit": total_fit(c("total"), c("target"), c("with_amount"), c("n")), "reconciled": F.coalesce((c("target") > 0) & (c("with_amount") / c("n") >= 0.8) & meets(c("total"), c("target")), F.lit(False))})
    bonus = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SOURCE_BONUS.items() for x in kv)), c("hyp")), F.lit(0.0))
    value = 0.30 * c("quality") + 0.34 * c("arith") + 0.24 * c("complete") + bonus + F.least(F.lit(0.08), 0.02 * c("charges")) + c("pattern") - F.least(F.lit(0.40), 0.5 * c("noise") / c("n")) + c("total_fit") + 0.08 * c("coverage")
    return per.select("doc_id", "hyp", "n", "quality", "arith", "complete", "pattern", "noise", "total_fit", "reconciled", "supported", value.alias("score"))


def partial_rejections(scores: DataFrame) -> DataFrame:
    """(doc_id, hyp) of readings that drop most of the current one's supported lines without meeting the printed total."""
    return with_rejection(scores).where("rejected").select("doc_id", "hyp")


def with_rejection(scores: DataFrame) -> DataFrame:
    """Adds ``rejected``, in one pass over the scores: their partition by document is the one that they were made in."""
    of_now = lambda c: F.max(F.when(F.col("hyp") == "current", F.col(c))).over(W.partitionBy("doc_id"))
    rows = scores.withColumns({"_supported": of_now("supported"), "_n": of_now("n")})
    lost = (F.col("_supported") >= 4) & (F.col("_supported") - F.col("supported") >= 2) & (F.col("n") / F.greatest("_n", F.lit(1)) < 0.70) & ~F.col("reconciled")
    return rows.withColumn("rejected", (F.col("hyp") != "current") & F.coalesce(lost, F.lit(False))).drop("_supported", "_n")


def winner(scores: DataFrame) -> DataFrame:
    """The best reading of each document that isn't rejected; ties go to more lines, then to the first by name."""
    kept = with_rejection(scores).where("NOT rejected").drop("rejected")
    return kept.groupBy("doc_id").agg(F.min_by(F.struct(*(c for c in scores.columns if c != "doc_id")), F.struct(-F.round("score", 9), -F.col("n"), "hyp")).alias("b")).select("doc_id", "b.*")


def best_set(lines: DataFrame) -> DataFrame:
    """The reading of each document with the best quality by itself, ties to more lines (up to 20), then to the first by ``rank``."""
    per = measures(lines).withColumn("quality", set_quality()).join(lines.groupBy("doc_id", "hyp").agg(F.min("rank").alias("rank")), ["doc_id", "hyp"])
    return per.groupBy("doc_id").agg(F.min_by(F.struct("hyp", "n", "quality"), F.struct(-F.round("quality", 9), -F.least("n", F.lit(20)), "rank")).alias("b")).select("doc_id", "b.*")
