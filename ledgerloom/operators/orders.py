"""Whole orders: every named check of lines, charges, totals, dates, parties and printed text, the auditor's issues, and the gate.

An order is a row of ``orders``: doc_id, number, order_date, delivery_date, currency, totals_currency, the totals, names of buyer,
supplier, ship_to and bill_to, ``contacts`` (array of role, field, value) and the pages' ``text``. Its ``lines`` and ``charges`` are
tables of their own, keyed by doc_id and ix. Lines and charges are aggregated once by document; everything else is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.judgements import any_of, digits, ladder, legal_footer, order_number_type, party_name_quality
from ..functions.money import cents, close
from ..functions.text import fold_spaces, phrase_count

#: Labels of pages that name a role or a column.
ROLE_LABELS = {"ship_to": ("adresse de livraison", "a livrer a", "livre a", "ship to"), "bill_to": ("facture a", "a facturer a", "bill to")}
COLUMN_LABELS = {"quantity": ("quantite", "qte", "qty"), "unit_price": ("prix net", "prix unitaire", "unit price", "pu ht", "p.u. h.t", "p.u ht"), "line_total": ("montant ht", "montant net", "mtt ht", "line total", "amount")}
#: The least share of lines with a field that the page's header names, the least quality of a party's name.
LEAST_SHARE, LEAST_QUALITY = 0.80, 0.45
#: Checks whose failure makes an order fail; the others warn.
CRITICAL = ("number_present", "number_type", "contact_collision")


def lines_summary(lines: DataFrame) -> DataFrame:
    """A row of counts for each document: one shuffle by document, in which the rows of a signature meet first."""
    n = lambda c: F.count_if(c)
    there = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("line_total").isNotNull()
    good = close(F.col("quantity") * F.col("unit_price"), F.col("line_total"))
    signature = ["material", "description", "quantity", "unit_price", "line_total"]
    some = F.coalesce(*(F.col(c).cast("string") for c in signature)).isNotNull()
    number = F.col("line_number").try_cast("long")
    order = W.partitionBy("doc_id").orderBy("ix")
    numbered = lines.withColumn("_n", number).withColumn("_before", F.last("_n", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    per = numbered.groupBy("doc_id", *signature).agg(
        F.count("*").alias("rows"), n(there).alias("checked"), n(there & good).alias("valid"), n(F.col("quantity") < 0).alias("negative_quantities"), n(F.col("unit_price") < 0).alias("negative_prices"),
        F.sum(cents(F.col("line_total"))).alias("cents"), F.count("_n").alias("numbers"), n(F.col("_n") <= F.col("_before")).alias("backward"),
        n(legal_footer(F.col("material"), F.col("material"), F.col("description"), F.col("raw_text"))).alias("footers"), F.collect_set(F.upper("currency")).alias("currencies"),
    )
    return per.groupBy("doc_id").agg(
        F.sum("rows").alias("n_lines"), *(F.sum(c).alias(c) for c in ("checked", "valid", "negative_quantities", "negative_prices", "numbers", "backward", "footers")), F.sum("cents").cast("double").alias("product_sum"),
        n(some & (F.col("rows") > 1)).alias("duplicates"), *(F.sum(F.when(F.col(c).isNotNull(), F.col("rows")).otherwise(0)).alias(f"with_{c}") for c in ("quantity", "unit_price", "line_total")),
        F.array_distinct(F.flatten(F.collect_list("currencies"))).alias("line_currencies"),
    )


def charges_summary(charges: DataFrame) -> DataFrame:
    there = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("amount").isNotNull()
    good = close(F.col("quantity") * F.col("unit_price"), F.col("amount"))
    return charges.groupBy("doc_id").agg(F.sum(cents(F.col("amount"))).cast("double").alias("charge_sum"), F.count_if(there).alias("charges_checked"), F.count_if(there & good).alias("charges_valid"))


def checks() -> dict[str, Column]:
    """Each check as a boolean column over the joined row: true holds, false fails, null wasn't checked."""
    c = F.col
    net, tax, gross = F.coalesce(c("total_net"), c("subtotal")), F.coalesce(c("total_tax"), c("total_vat")), F.coalesce(c("total_gross"), c("total_after_tax"))
    document = c("product_sum") + F.coalesce(c("charge_sum"), F.lit(0.0))
    parts = [tax, c("total_freight"), c("total_shipping"), c("total_surcharge"), c("total_discount"), c("rounding")]
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    expected = net + zero(tax) + zero(c("total_freight")) + zero(c("total_shipping")) + zero(c("total_surcharge")) - zero(c("total_discount")) + zero(c("rounding"))
    some_part = F.coalesce(*parts).isNotNull()
    low = c("_low")
    has_lines = F.coalesce(c("n_lines"), F.lit(0)) > 0
    currencies = F.array_distinct(F.array_compact(F.concat(F.array(F.upper("currency"), F.upper("totals_currency")), F.coalesce(c("line_currencies"), F.array().cast("array<string>")))))
    share = lambda f: c(f"with_{f}") / c("n_lines")
    filled = F.lit(True)
    for f, labels in COLUMN_LABELS.items():
        filled = filled & (~any_of(low, labels) | (share(f) >= LEAST_SHARE))
    plausible = lambda f: c(f"_{f}_quality") >= LEAST_QUALITY
    labelled = F.lit(True)
    for role, labels in ROLE_LABELS.items():
        labelled = labelled & (~any_of(low, labels) | plausible(role))
    words = F.regexp_replace(low, "[.]", "")
    printed_net = words.rlike(r"\btotal (eur )?(h ?t|net ht)\b") | words.rlike(r"\b(mt|mnt|mi) h ?t [0-9 ]*[0-9]")
    printed = printed_net | F.contains(low, F.lit("net a payer"))
    extracted = net.isNotNull() | (~printed_net & c("grand_total").isNotNull())
    bare = F.regexp_replace(F.trim(c("number")), " ", "")
    collides = F.exists(F.coalesce(c("contacts"), F.array().cast("array<struct<role:string,field:string,value:string>>")), lambda k: (F.length(digits(k["value"])) >= 7) & (digits(k["value"]) == bare))
    target = net.isNotNull()
    return {
        "number_present": F.coalesce(c("number"), F.lit("")) != "",
        "number_type": F.when(c("number").isNotNull(), order_number_type(c("number"))),
        "contact_collision": F.when(bare.rlike("^[0-9]+$"), ~collides),
        "lines_present": has_lines,
        "quantity_price": F.when(c("checked") > 0, c("checked") == c("valid")),
        "negative_quantities": F.when(has_lines, c("negative_quantities") == 0),
        "negative_prices": F.when(has_lines, c("negative_prices") == 0),
        "line_sum": F.when(c("product_sum").isNotNull() & target, close(F.when(c("charge_sum").isNotNull(), document).otherwise(c("product_sum")), net)),
        "charge_arithmetic": F.when(c("charges_checked") > 0, c("charges_checked") == c("charges_valid")),
        "tax_total": F.when(net.isNotNull() & tax.isNotNull() & gross.isNotNull(), close(net + tax, gross)),
        "grand_total": F.when(c("grand_total").isNotNull() & net.isNotNull() & some_part, close(expected, c("grand_total"))),
        "date_consistency": F.when(c("order_date").isNotNull() & c("delivery_date").isNotNull(), c("order_date") <= c("delivery_date")),
        "currency_consistency": F.array_size(currencies) <= 1,
        "number_sequence": F.when(c("numbers") >= 2, c("backward") == 0),
        "duplicate_lines": F.when(has_lines, c("duplicates") == 0),
        "party_roles": plausible("buyer") & plausible("supplier") & labelled,
        "field_completeness": F.when(has_lines, filled),
        "printed_total": ~printed | extracted,
        "legal_footer_lines": F.when(has_lines, c("footers") == 0),
    }


def joined(orders: DataFrame, lines: DataFrame, charges: DataFrame) -> DataFrame:
    """Orders with their counts; the folded text and the quality of the names are made once."""
    names = {f"_{f}_quality": party_name_quality(F.col(f"{f}_name")) for f in ("buyer", "supplier", "ship_to", "bill_to")}
    return orders.withColumns({"_low": fold_spaces(F.col("text")), **names}).join(lines_summary(lines), "doc_id", "left").join(charges_summary(charges), "doc_id", "left")


def validate(orders: DataFrame, lines: DataFrame, charges: DataFrame) -> DataFrame:
    """A row for each order: each check's verdict, the names of what fails as errors and warnings, and PASS, WARNING or FAIL."""
    found = checks()
    rows = joined(orders, lines, charges).select("doc_id", *(v.alias(k) for k, v in found.items()))
    failing = lambda names: F.array_compact(F.array(*(F.when(~F.col(k), F.lit(k)) for k in names)))
    rows = rows.withColumn("errors", failing(CRITICAL)).withColumn("warnings", failing([k for k in found if k not in CRITICAL]))
    return rows.withColumn("status", ladder((F.array_size("errors") > 0, "FAIL"), (F.array_size("warnings") > 0, "WARNING"), otherwise="PASS"))


def audit_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, code, severity, path): repeated line numbers, and amounts that the price of its basis doesn't explain.

    Net prices hold discounts already; a gross price is left alone where the line has a discount or surcharge.
    """
    path = F.concat(F.lit("purchase_order.lines["), (F.col("ix") - 1).cast("string"), F.lit("]"))
    number = F.coalesce(F.col("line_number").cast("string"), F.lit(""))
    again = (number != "") & (F.row_number().over(W.partitionBy("doc_id", "line_number").orderBy("ix")) > 1)
    price, basis = F.coalesce("net_unit_price", "unit_price"), F.coalesce(F.nullif("price_unit", F.lit(0.0)), F.lit(1.0))
    free = F.col("net_unit_price").isNotNull() | (F.coalesce("adjustment", F.lit(0.0)) == 0)
    allowed = F.greatest(F.lit(0.03), F.abs(F.col("quantity") / basis) * 0.005 + 0.005)
    wrong = F.abs(F.col("quantity") * price / basis - F.col("line_total")) > allowed
    issue = lambda when, code, at: F.when(when, F.struct(F.lit(code).alias("code"), F.lit("warning").alias("severity"), at.alias("path")))
    marked = lines.withColumn("_again", again)
    issues = F.array_compact(F.array(issue(F.col("_again"), "DUPLICATE_LINE_NUMBER", F.concat(path, F.lit(".line_number"))), issue((basis > 0) & free & wrong, "LINE_AMOUNT_MISMATCH", path)))
    return marked.select("doc_id", F.explode(issues).alias("i")).select("doc_id", "i.*")


def audit_totals(orders: DataFrame) -> DataFrame:
    """An issue for each order whose net and tax miss its gross total by over 0.05."""
    net, tax, gross = F.coalesce("total_net", "subtotal"), F.coalesce("total_vat", "total_tax"), F.coalesce("grand_total", "total_gross")
    wrong = F.abs(net + tax - gross) > 0.05
    return orders.where(wrong).select("doc_id", F.lit("TOTAL_ARITHMETIC_MISMATCH").alias("code"), F.lit("warning").alias("severity"), F.lit("purchase_order.totals").alias("path"))


def audit_addresses(addresses: DataFrame) -> DataFrame:
    """Issues of address blocks (doc_id, ix, postal_code, city, country_code, latitude, longitude, verified, verification_status, verification_provider, formatted)."""
    at = lambda tail: F.concat(F.lit("addresses["), F.col("ix").cast("string"), F.lit("]" + tail))
    postal, city = F.coalesce("postal_code", F.lit("")), F.coalesce("city", F.lit(""))
    status = F.upper(F.coalesce("verification_status", F.lit("")))
    sure = status.isin("VERIFIED", "CONFIRMED")
    twice = phrase_count(F.col("formatted"), F.col("city")) > 1
    rules = [
        ((city != "") & F.coalesce(twice, F.lit(False)), "ADDRESS_DUPLICATE_CITY", "warning", ".formatted_address"),
        ((postal != "") & (F.upper("country_code") == "FR") & ~F.trim(postal).rlike("^[0-9]{5}$"), "FR_POSTAL_CODE_INVALID", "warning", ".address.postal_code"),
        ((postal != "") & (city == ""), "ADDRESS_CITY_MISSING", "warning", ".address.city"),
        (F.abs("latitude") > 90, "LATITUDE_OUT_OF_RANGE", "error", ".address.latitude"),
        (F.abs("longitude") > 180, "LONGITUDE_OUT_OF_RANGE", "error", ".address.longitude"),
        (F.col("verified") & ~sure, "VERIFICATION_STATUS_CONTRADICTION", "error", ""),
        (sure & (F.coalesce("verification_provider", F.lit("")) == ""), "VERIFICATION_PROVIDER_MISSING", "warning", ""),
    ]
    issues = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), at(tail).alias("path"))) for when, code, severity, tail in rules)))
    return addresses.select("doc_id", F.explode(issues).alias("i")).select("doc_id", "i.*")


def quality(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """Each document's counts of issues by severity and its status: ERROR, WARN or PASS."""
    per = issues.groupBy("doc_id").agg(F.count("*").alias("issue_count"), F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    counts = ("issue_count", "error_count", "warning_count")
    rows = documents.select("doc_id").join(per, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    return rows.withColumn("status", ladder((F.col("error_count") > 0, "ERROR"), (F.col("warning_count") > 0, "WARN"), otherwise="PASS"))


#: Legal forms alone, which name no party; what a reference lookup says, and the reason it gives.
BARE_FORMS = ("SAS", "SASU", "SARL", "SA", "EURL", "GMBH", "LTD", "LLC")
LOOKUPS = {"DEPARTMENT_NOT_INDEXED": "ADDRESS_REFERENCE_UNAVAILABLE", "NOT_FOUND": "ADDRESS_NOT_FOUND_IN_REFERENCE", "CLOSE_STREET_MATCH": "ADDRESS_REFERENCE_SUGGESTION", "STREET_MATCH_NUMBER_NOT_FOUND": "ADDRESS_NUMBER_NOT_FOUND_IN_REFERENCE"}


def _reasons(rules: list[tuple[Column, str, Column]]) -> Column:
    """(code, path) of each rule that is broken."""
    return F.explode(F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), path.alias("path"))) for holds, code, path in rules))))


def gate(orders: DataFrame, lines: DataFrame, addresses: DataFrame, validation: DataFrame, issues: DataFrame) -> DataFrame:
    """The decision for every document: CHECKS_PASSED, or REVIEW_REQUIRED with its reasons, each (code, path) once, in order.

    ``orders`` also has document_type; ``lines`` reference and reference_status; ``addresses`` doc_id, ix, role, role_confidence, postal_code, city and reference_status.
    """
    c = F.col
    there = lambda x: F.coalesce(x.cast("string"), F.lit("")) != ""
    p = lambda s: F.lit(s)
    informative = lambda name: ~there(c(name)) | ~F.regexp_replace(F.upper(c(name)), "[^A-Z0-9]", "").isin(*BARE_FORMS)
    is_order = c("document_type").isin("purchase_order", "purchase_order_with_terms")
    roles = addresses.groupBy("doc_id").agg(F.collect_set(F.lower("role")).alias("roles"), F.count_if(F.lower("role") == "ship_to").alias("deliveries"))
    counted = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    base = orders.join(validation.select("doc_id", c("status").alias("validation_status"), "contact_collision"), "doc_id", "left").join(counted, "doc_id", "left").join(roles, "doc_id", "left")
    has_role = lambda r: F.array_contains(F.coalesce("roles", F.array().cast("array<string>")), r)
    ordered = base.where(is_order).select("doc_id", _reasons([
        (there(c("number")), "ORDER_NUMBER_MISSING", p("purchase_order.number")), (there(c("order_date")), "ORDER_DATE_MISSING", p("purchase_order.order_date")), (c("total_net").isNotNull(), "ORDER_TOTAL_MISSING", p("totals.total_net")),
        (there(c("buyer_name")), "PARTY_NAME_MISSING", p("buyer")), (there(c("supplier_name")), "PARTY_NAME_MISSING", p("supplier")), (informative("buyer_name"), "PARTY_NAME_UNINFORMATIVE", p("buyer")), (informative("supplier_name"), "PARTY_NAME_UNINFORMATIVE", p("supplier")),
        (F.coalesce("contact_collision", F.lit(True)), "PARTY_CONTACT_ROLE_CONFLICT", p("buyer/supplier.contact")), (F.coalesce("n_lines", F.lit(0)) > 0, "ORDER_LINES_MISSING", p("lines")), (c("validation_status") == "PASS", "BUSINESS_VALIDATION_INCOMPLETE", p("validation")),
        (has_role("ship_to"), "ADDRESS_ROLE_MISSING", p("business_addresses.ship_to")), (has_role("bill_to"), "ADDRESS_ROLE_MISSING", p("business_addresses.bill_to")), (F.coalesce("deliveries", F.lit(0)) <= 1, "DELIVERY_ADDRESS_AMBIGUOUS", p("business_addresses.ship_to")),
    ]).alias("r"))
    other = base.where(~F.coalesce(is_order, F.lit(False))).select("doc_id", F.struct(F.lit("NOT_A_STRUCTURED_PURCHASE_ORDER").alias("code"), F.lit("document").alias("path")).alias("r"))
    line = F.concat(F.lit("lines["), (c("ix") - 1).cast("string"), F.lit("]"))
    of_lines = lines.select("doc_id", _reasons([
        (there(c("reference")), "PRODUCT_REFERENCE_MISSING", line), (~F.coalesce(c("reference_status"), F.lit("")).isin("ALPHA_ONLY", "TEXT_CAPTURE"), "PRODUCT_REFERENCE_IMPLAUSIBLE", F.concat(line, F.lit(".material_number"))),
        (c("quantity").isNotNull(), "QUANTITY_MISSING", line), (c("unit_price").isNotNull(), "UNIT_PRICE_MISSING", line), (c("line_total").isNotNull(), "LINE_TOTAL_MISSING", line),
    ]).alias("r"))
    block = F.concat(F.lit("business_addresses["), c("ix").cast("string"), F.lit("]"))
    known = ~F.coalesce(F.lower("role"), F.lit("")).isin("", "unknown", "unassigned", "other")
    of_addresses = addresses.select("doc_id", _reasons([
        (known, "ADDRESS_ROLE_UNRESOLVED", block), (F.coalesce("role_confidence", F.lit(1.0)) >= 0.80, "ADDRESS_ROLE_UNCERTAIN", block), (there(c("postal_code")) & there(c("city")), "ADDRESS_LOCALITY_INCOMPLETE", block),
        *((F.coalesce("reference_status", F.lit("")) != status, code, block) for status, code in LOOKUPS.items()),
    ]).alias("r"))
    orders_only = orders.where(is_order).select("doc_id")
    audited = issues.where((c("code") != "ADDRESS_DUPLICATE_CITY") & c("severity").isin("error", "warning")).select("doc_id", F.struct("code", "path").alias("r"))
    reasons = ordered.unionByName(other).unionByName(of_lines.unionByName(of_addresses).join(orders_only, "doc_id", "left_semi")).unionByName(audited)
    per = reasons.groupBy("doc_id").agg(F.sort_array(F.collect_set("r")).alias("reasons"))
    out = orders.select("doc_id").join(per, "doc_id", "left")
    review = c("reasons").isNotNull()
    return out.select("doc_id", F.when(review, "REVIEW_REQUIRED").otherwise("CHECKS_PASSED").alias("decision"), F.coalesce(F.array_size("reasons"), F.lit(0)).alias("n_reasons"), F.array_distinct(F.transform(F.coalesce("reasons", F.array().cast("array<struct<code:string,path:string>>")), lambda r: r["code"])).alias("codes"))


def dedupe_lines(lines: DataFrame) -> DataFrame:
    """The first of lines alike in page, number, folded references and description, quantity, price and amount; numbers that lack are filled by place."""
    from ..functions.identifiers import continuation_row

    kept = lines.where(~continuation_row(F.col("raw_text")) & ~continuation_row(F.col("description")))
    text = lambda c: fold_spaces(F.col(c))
    keys = ["doc_id", "page", F.trim(F.coalesce("line_number", F.lit(""))), text("material"), text("supplier_material"), text("description"), "quantity", "unit_price", "line_total"]
    first = kept.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("ix"))).where("_n = 1").drop("_n")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("ix")).cast("string")
    return first.withColumn("line_number", F.coalesce(F.nullif("line_number", F.lit("")), place))


def renumber(lines: DataFrame) -> DataFrame:
    """Printed numbers stay; lines without a printed one get, in order, the numbers from 1 that no line prints; all by place if none prints one.

    The n-th free number is n and as many more as printed numbers stand below it, found by counting within the document's sorted printed numbers.
    """
    from ..functions.judgements import backed_number

    all_ = W.partitionBy("doc_id")
    rows = lines.withColumn("_backed", backed_number(F.col("line_number"), F.col("raw_text")))
    used = F.sort_array(F.collect_set(F.when(F.col("_backed"), F.trim("line_number").try_cast("int"))).over(all_))
    rows = rows.withColumn("_used", F.filter(used, lambda u: u >= 1)).withColumn("_k", F.sum((~F.col("_backed")).cast("int")).over(all_.orderBy("ix")).cast("int"))
    free = F.aggregate("_used", F.col("_k"), lambda at, u: F.when(u <= at, at + 1).otherwise(at))
    return rows.withColumn("line_number", F.when(F.col("_backed"), F.trim("line_number")).otherwise(free.cast("string"))).drop("_backed", "_used", "_k")


def without_footers(lines: DataFrame) -> DataFrame:
    """Lines without company registration text, numbered anew."""
    return renumber(lines.where(~legal_footer(F.col("material"), F.col("raw_text"), F.col("description"))))


def rejected_reason(supported: Column) -> Column:
    """Why a line is no product: a quote's note, a date beside a footer, or under two commercial values without a supported reference and a description; null keeps it."""
    from ..functions.judgements import date_like, words_in
    from ..functions.text import fold

    low = fold(F.concat_ws(" ", "description", "raw_text"))
    footer = words_in(low, ("poids", "total hors", "total ht", "total ttc", "reglement", "condition generale", "conditions generales", "condition generales", "conditions generale"))
    values = sum((F.col(c).isNotNull().cast("int") for c in ("quantity", "unit_price", "line_total")), F.lit(0))
    fragment = (values < 2) | F.col("quantity").isNull()
    material = F.coalesce(F.trim("material"), F.lit(""))
    return ladder((fold(material).isin("offre", "devis", "quote"), "quote_note_as_product"), (date_like(material) & footer, "date_footer_as_product"), (fragment & (~supported | (F.length(F.coalesce(F.trim("description"), F.lit(""))) < 3)), "non_commercial_fragment"))


def rejected_counts(lines: DataFrame) -> DataFrame:
    """(doc_id, reason, n) of the lines that ``rejected_reason`` drops; ``supported`` is a column of ``lines``."""
    return lines.withColumn("reason", rejected_reason(F.col("supported"))).where("reason IS NOT NULL").groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


def totals_from_rows(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Totals of printed rows (doc_id, ix, text): for each label pattern the last number of the last row that has it."""
    from ..functions.numbers import money

    number = r"([0-9][0-9 .,]*[0-9]|[0-9])\s*(?:€|eur)?\s*$"
    pick = lambda p: F.max(F.when(F.col("low").rlike(p) & F.col("low").rlike(number), F.struct("ix", money(F.regexp_extract("low", number, 1)).alias("v"))))["v"]
    return rows.withColumn("low", fold_spaces(F.col("text"))).groupBy("doc_id").agg(*(pick(p).alias(k) for k, p in patterns.items()))


def uniform_date(lines: DataFrame) -> DataFrame:
    """(doc_id, delivery_date) where all dated lines agree on one."""
    return lines.where("delivery_date IS NOT NULL").groupBy("doc_id").agg(F.min("delivery_date").alias("delivery_date"), F.max("delivery_date").alias("_last")).where("delivery_date = _last").drop("_last")
