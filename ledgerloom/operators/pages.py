"""What the text of pages holds: entities with guards, labelled values, structured values, coordinates for text that has none."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identifiers import plausible_phone
from ..functions.judgements import any_of
from ..functions.text import fold_spaces, squeezed

#: Patterns that Java and RE2 read alike, and the confidence of each kind (fixed values).
ENTITIES = {
    "EMAIL": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0.99),
    "URL": (r"(?i)https?://[^\s<>()]+", 0.99),
    "IBAN": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", 0.98),
    "DATE": (r"\b(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})\b", 0.90),
    "AMOUNT": (r"(?:(?:EUR|USD|GBP|CHF|[€$£]) ?)?[+-]?[0-9]+(?:[ .'][0-9]{3})*[.,][0-9]{2}\b(?: ?(?:EUR|USD|GBP|CHF|[€$£]))?", 0.90),
    "PERCENT": (r"\b[0-9]+(?:[.,][0-9]+)? ?%", 0.95),
    "PHONE": (r"\+?[0-9][0-9 .()-]{5,18}[0-9]", 0.75),
}
#: What, beside a number, shows that it is no phone; what shows that a number is money.
REGISTRATION = ("siret", "rcs", "tva", "vat", "iban", "bic", "ape", "capital")
MONEY = ("eur", "usd", "gbp", "chf", "€", "$", "£", "montant", "prix", "euros", "dollars")
MOST_ENTITIES, MOST_PAIRS, MOST_PATHS = 5000, 1000, 2000


def around(text: Column, pattern: str, radius: int) -> Column:
    """Array of (value, context) of a pattern's hits: the context has up to ``radius`` characters on both sides."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    pieces = F.split(text, pattern)  # what lies between hits: one more than hits
    near = lambda i: F.concat(F.right(F.get(pieces, i), F.lit(radius)), F.lit(" "), F.left(F.coalesce(F.get(pieces, i + 1), F.lit("")), F.lit(radius)))
    return F.transform(hits, lambda v, i: F.struct(F.trim(v).alias("value"), near(i).alias("context")))


def entities(blocks: DataFrame, limit: int = MOST_ENTITIES) -> DataFrame:
    """(doc_id, ix, label, value, confidence): the distinct entities of each page of blocks (doc_id, ix, page, text, page_kind), the first ``limit`` of a document.

    A phone is plausible and stands beside no registration; on a page of legal terms an amount needs money beside it and is no clause number.
    """
    found = []
    for label, (pattern, confidence) in ENTITIES.items():
        hits = around(F.col("text"), pattern, 28)
        if label == "PHONE":
            hits = F.filter(hits, lambda h: plausible_phone(h["value"]) & ~any_of(fold_spaces(h["context"]), REGISTRATION))
        if label == "AMOUNT":
            hits = F.filter(hits, lambda h: (F.coalesce("page_kind", F.lit("")) != "legal_terms") | (any_of(F.lower(F.concat(h["value"], h["context"])), MONEY) & ~h["value"].rlike("^[0-9]{1,2}[.][0-9]{1,2}$")))
        found.append(F.transform(hits, _tagged(label, confidence)))
    rows = blocks.select("doc_id", "ix", "page", F.posexplode(F.concat(*found)).alias("at", "e")).select("doc_id", "ix", "page", "at", "e.*")
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "page", "label", "value").orderBy("ix", "at"))).where("_n = 1").drop("_n")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("ix", "at"))
    return first.withColumn("_place", place).where(F.col("_place") <= limit).select("doc_id", "ix", "label", "value", "confidence")


def _tagged(label: str, confidence: float):
    return lambda h: F.struct(F.lit(label).alias("label"), h["value"].alias("value"), F.lit(confidence).alias("confidence"))


def key_values(blocks: DataFrame, cells: DataFrame, limit: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, label, value, confidence): lines that read ``label: value`` or ``label = value``, and table rows of two cells; each pair once a document.

    ``blocks`` has doc_id, ix, text; ``cells`` has doc_id, table, row, column, text.
    """
    lines = blocks.select("doc_id", "ix", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).withColumn("line", squeezed(F.col("line")))
    pattern = lambda sign: f"^([^{sign}]{{2,80}}?) ?{sign} ?(.{{1,500}})$"
    pick = lambda i: F.when(F.col("line").rlike(pattern(":")), F.regexp_extract("line", pattern(":"), i)).when(F.col("line").rlike(pattern("=")), F.regexp_extract("line", pattern("="), i))
    printed = lines.select("doc_id", F.lit(0).alias("part"), "ix", "at", F.trim(pick(1)).alias("label"), F.trim(pick(2)).alias("value"), F.lit(0.95).alias("confidence"))
    there = F.trim(F.coalesce("text", F.lit(""))) != ""
    pairs = cells.where(there).groupBy("doc_id", "table", "row").agg(F.sort_array(F.collect_list(F.struct("column", F.trim("text").alias("text")))).alias("c")).where(F.array_size("c") == 2)
    tabled = pairs.select("doc_id", F.lit(1).alias("part"), F.col("table").alias("ix"), F.col("row").alias("at"), F.col("c")[0]["text"].alias("label"), F.col("c")[1]["text"].alias("value"), F.lit(0.90).alias("confidence")).where(F.length("label").between(2, 100))
    rows = printed.unionByName(tabled).where("label <> '' AND value <> ''")
    order = W.partitionBy("doc_id", F.lower("label"), "value").orderBy("part", "ix", "at")
    first = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("part", "ix", "at"))
    return first.withColumn("_place", place).where(F.col("_place") <= limit).select("doc_id", "label", "value", "confidence")


def json_tree(rows: DataFrame, key: str, column: str, limit: int = MOST_PATHS, skip_private: bool = False) -> DataFrame:
    """(key, path, value) of all scalars of JSON documents, however deep: ``a.b[0].c``; nulls are left out, bad JSON gives no row.

    ``skip_private`` leaves out keys that begin with an underscore and ``spatial``, as comparisons do.
    """

    def walk(value, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(value, dict):
            for k, v in value.items():
                if not (skip_private and (k == "spatial" or k.startswith("_"))):
                    yield from walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, f"{path}[{i}]")
        elif value is not None and path:
            yield path, value if isinstance(value, str) else json.dumps(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b["key"], b["text"], strict=True):
                try:
                    tree = json.loads(text) if text is not None else None
                except ValueError:
                    continue
                out += [(k, p, v) for (p, v), _ in zip(walk(tree, ""), range(limit), strict=False)]
            yield pd.DataFrame(out, columns=["key", "path", "value"])

    kind = rows.schema[key].dataType.simpleString()
    flat = rows.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInPandas(run, f"key {kind}, path string, value string")
    return flat.withColumnRenamed("key", key)


def synthetic_words(blocks: DataFrame) -> DataFrame:
    """(doc_id, line, place, text, x0, y0, x1, y1): words of blocks (doc_id, ix, text) laid out on lines of 16 units, six units a character and five between."""
    there = blocks.where(F.trim("text") != "")
    line = F.row_number().over(W.partitionBy("doc_id").orderBy("ix")) - 1
    words = F.filter(F.split(squeezed(F.col("text")), " "), lambda w: w != "")
    rows = there.withColumn("line", line).select("doc_id", "line", F.posexplode(words).alias("place", "text"))
    width = F.greatest(F.lit(8.0), F.length("text") * 6.0)
    before = F.coalesce(F.sum(width + 5.0).over(W.partitionBy("doc_id", "line").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    x0, y0 = 10.0 + before, 10.0 + 16.0 * F.col("line")
    return rows.select("doc_id", "line", "place", "text", x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + 10.0).alias("y1"))


def continuation(pages: DataFrame) -> DataFrame:
    """Runs of neighbouring pages of one kind: (doc_id, run, kind, first_page, last_page, n)."""
    order = W.partitionBy("doc_id").orderBy("page")
    new = F.coalesce((F.col("kind") != F.lag("kind").over(order)) | (F.col("page") - F.lag("page").over(order) > 1), F.lit(True))
    runs = pages.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc_id", "run", "kind").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n"))
