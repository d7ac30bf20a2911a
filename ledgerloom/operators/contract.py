"""The published form of an order: fields with what they were read from, contacts, parties, lines and charges as nested values without empty parts, and the writers of reports and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import dimensions, kept_phone, without_repeats
from ..functions.text import line_spacing


def present(x: Column) -> Column:
    """The text without outer blanks, null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def first_value(*values: Column) -> Column:
    """The first of values that holds something."""
    return F.coalesce(*(present(v) for v in values))


def field(value: Column, raw: Column, confidence: Column, status: Column, page: Column, source_text: Column, method: Column) -> Column:
    """A published field: its value with single blanks, the raw text only if it differs, and its evidence; null without a value."""
    tidy = present(line_spacing(value))
    evidence = F.struct(page.alias("page"), source_text.alias("source_text"), method.alias("method"))
    some = F.coalesce(page.cast("string"), source_text, method).isNotNull()
    return F.when(tidy.isNotNull(), F.struct(tidy.alias("value"), F.when(F.coalesce(raw, value) != tidy, F.coalesce(raw, value)).alias("raw_value"), confidence.alias("confidence"), status.alias("status"), F.when(some, evidence).alias("evidence")))


def contact(name: Column, email: Column, phone: Column, fax: Column, nested_email: Column, nested_phone: Column, nested_fax: Column) -> Column:
    """A published contact: a role's own mail and numbers before those of a nested contact, which may be a neighbour's; numbers only if they can be phones."""
    return F.struct(present(name).alias("name"), first_value(email, nested_email).alias("email"), kept_phone(first_value(phone, nested_phone)).alias("phone"), kept_phone(first_value(fax, nested_fax)).alias("fax"))


def locality(postal_code: Column, city: Column) -> Column:
    """Struct (postal_code, city, postal_routing_code): a city that begins with another code gives that code and keeps the first as routing; one that repeats the code loses it."""
    shifted = F.regexp_extract(city, r"^\s*([0-9]{5})\s+(.+)$", 1)
    moved = (shifted != "") & (shifted != postal_code) & postal_code.rlike("^[0-9]{5}$")
    rest = present(F.regexp_extract(city, r"^\s*([0-9]{5})\s+(.+)$", 2))
    plain = F.when((shifted != "") & (shifted == postal_code), rest).otherwise(without_repeats(city))
    return F.struct(F.when(moved, shifted).otherwise(postal_code).alias("postal_code"), F.when(moved, rest).otherwise(plain).alias("city"), F.when(moved, postal_code).alias("postal_routing_code"))


def line(lines: DataFrame) -> DataFrame:
    """(doc_id, ix, line): lines in published form; lines have line_number, material, ean, description, quantity, ordered_quantity, uom, unit_price, net_unit_price, currency, line_total, requested_date, delivery_date, status, page."""
    c = F.col
    whole = F.struct(
        c("line_number"), F.struct("material", "ean").alias("references"), dimensions(c("description")).alias("description"), F.coalesce("quantity", "ordered_quantity").alias("quantity"), c("uom").alias("unit"), F.struct("unit_price", "net_unit_price", "currency").alias("pricing"),
        F.struct(c("line_total").alias("total")).alias("amounts"), F.struct(F.coalesce("requested_date", "delivery_date").alias("date")).alias("delivery"), c("status"), F.struct("page").alias("evidence"),
    )
    return lines.select("doc_id", "ix", whole.alias("line"))


def charge(charges: DataFrame) -> DataFrame:
    """(doc_id, ix, charge) in published form; charges have charge_type, description, supplier_reference, code, quantity, unit_price, amount, currency."""
    return charges.select("doc_id", "ix", F.struct(F.col("charge_type").alias("type"), "description", first_value(F.col("supplier_reference"), F.col("code")).alias("reference"), "quantity", "unit_price", "amount", "currency").alias("charge"))


def published(orders: DataFrame, lines: DataFrame, charges: DataFrame) -> DataFrame:
    """(doc_id, json): the contract of each order as JSON without empty parts: orders have doc_id, filename, number and buyer (structs as above); lines and charges come from ``line`` and ``charge``."""
    of = lambda rows, name: rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ix", F.to_json(name).alias("j")))), lambda x: x["j"]).alias(f"{name}s"))
    rows = orders.join(of(lines, "line"), "doc_id", "left").join(of(charges, "charge"), "doc_id", "left")
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))
    head = F.to_json(F.struct(F.lit("3.0").alias("schema_version"), "filename", F.struct("number", "buyer").alias("order")))
    return rows.select("doc_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"lines":'), listed(F.col("lines")), F.lit(',"charges":'), listed(F.col("charges")), F.lit("}")).alias("json"))


def upgraded(old: DataFrame) -> DataFrame:
    """(doc_id, json): contracts of version 2, whose number is a bare value and whose party is flat, in version 3; those of version 3 stay."""
    j = F.col("json")
    at = lambda path: F.get_json_object(j, path)
    new = F.to_json(F.struct(F.lit("3.0").alias("schema_version"), at("$.filename").alias("filename"), F.struct(F.struct(at("$.order_number").alias("value")).alias("number"), F.struct(at("$.buyer_name").alias("name")).alias("buyer")).alias("order")))
    return old.select("doc_id", F.when(at("$.schema_version") == "3.0", j).otherwise(new).alias("json"))


def write_new(rows: DataFrame, path: str) -> None:
    """JSON into a folder that must not exist."""
    rows.write.mode("errorifexists").json(path)


def write_report(tables: list[DataFrame], path: str) -> None:
    """Tables with different columns as one CSV with a header, also when they are empty, into a folder that must not exist."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    whole.write.mode("errorifexists").option("header", True).csv(path)


def write_index(keys: DataFrame, streets: DataFrame, folder: str) -> None:
    """An address index as tables by department, keys sorted in each file; read again by equality of department and key."""
    keys.distinct().repartition("department").sortWithinPartitions("department", "key").write.partitionBy("department").mode("errorifexists").parquet(f"{folder}/keys")
    streets.repartition("department").sortWithinPartitions("department", "postal_code").write.partitionBy("department").mode("errorifexists").parquet(f"{folder}/streets")


def dataset(documents: DataFrame, splits: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A dataset's manifest (doc_id, split, sha256, fields) and its statistics (split, documents, fields): documents with at least one annotation (doc_id, payload)."""
    per = annotations.groupBy("doc_id").agg(F.count("*").alias("fields"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("payload", 256))), ""), 256).alias("sha256"))
    manifest = documents.select("doc_id").join(per, "doc_id").join(splits, "doc_id").select("doc_id", "split", "sha256", "fields")
    return manifest, manifest.groupBy("split").agg(F.count("*").alias("documents"), F.sum("fields").alias("fields"))
