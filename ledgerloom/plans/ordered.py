"""Queries of whole orders: the order tables with planted faults, read by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orders as O
from .registry import query, table

_IX = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT)"
#: lineitem as printed lines; every few dozen parts have a fault of their own.
_LINE = [
    "l_orderkey AS doc_id", f"{_IX} AS ix", "CASE WHEN l_partkey % 47 = 0 THEN NULL ELSE CAST(l_linenumber * 10 AS STRING) END AS line_number", "CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE lpad(CAST(l_partkey AS STRING), 8, '0') END AS material",
    "CASE WHEN l_partkey % 211 = 0 THEN 'SIRET 123 RCS Paris' ELSE concat('Item ', CAST(l_partkey AS STRING)) END AS description", "CASE WHEN l_partkey % 89 = 0 THEN -l_quantity WHEN l_partkey % 83 = 0 THEN NULL ELSE l_quantity END AS quantity",
    "CASE WHEN l_partkey % 79 = 0 THEN -1.0 WHEN l_partkey % 71 = 0 THEN l_extendedprice / l_quantity * 1.1 ELSE l_extendedprice / l_quantity END AS unit_price", "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_extendedprice END AS line_total",
    "CASE WHEN l_partkey % 301 = 0 THEN 'usd' ELSE NULL END AS currency", "concat(CAST(l_linenumber * 10 AS STRING), CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE 'x' END, 'row') AS raw_text", "l_partkey AS k", "l_suppkey AS s", "l_tax AS tax",
]
_CHARGE = ["l_orderkey AS doc_id", f"{_IX} AS ix", "1.0 AS quantity", "12.5 AS unit_price", "CASE WHEN l_suppkey % 5 = 0 THEN 13.5 ELSE 12.5 END AS amount", "l_linenumber AS n"]
_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN 'Quantité  Prix unitaire  Montant HT - Total H.T. - Adresse de livraison' WHEN 1 THEN 'Bon de commande, net à payer' WHEN 2 THEN 'P.U. H.T Qté' ELSE 'Facture à' END"
_ORDER = [
    "o_orderkey AS doc_id", "CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN 'tel 0123' WHEN o_orderkey % 67 = 0 THEN '0612345678' ELSE concat('PO-', CAST(o_orderkey AS STRING)) END AS number",
    "CAST(o_orderdate AS DATE) AS order_date", "CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN CAST(o_orderdate - INTERVAL 5 DAY AS DATE) ELSE CAST(o_orderdate + INTERVAL 10 DAY AS DATE) END AS delivery_date",
    "'EUR' AS currency", "CASE WHEN o_orderkey % 41 = 0 THEN 'CHF' ELSE 'eur' END AS totals_currency", "concat('Customer ', CAST(o_custkey AS STRING)) AS customer",
    "CASE WHEN o_orderkey % 37 = 0 THEN 'Telephone 12' WHEN o_orderkey % 43 = 0 THEN 'SAS' ELSE concat('Customer ', CAST(o_custkey AS STRING)) END AS buyer_name", "CASE WHEN o_orderkey % 73 = 0 THEN NULL ELSE 'Fournitures SA' END AS supplier_name",
    "CASE WHEN o_orderkey % 8 = 0 THEN 'rue du Port' ELSE 'Depot Nord' END AS ship_to_name", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Siege' END AS bill_to_name", "CASE WHEN o_orderkey % 67 = 0 THEN '06 12 34 56 78' ELSE '01 44 55 66 77' END AS phone",
    f"{_TEXT} AS text", "CASE WHEN o_orderkey % 101 = 0 THEN 'offer' ELSE 'purchase_order' END AS document_type", "o_orderkey AS k",
]
#: Totals from the exact sum of the lines and charges, with faults.
_NET = "net + CASE WHEN k % 13 = 0 THEN 5.0 ELSE 0.0 END"
_TOTAL = [
    f"CASE WHEN k % 17 = 0 THEN NULL ELSE {_NET} END AS total_net", f"CASE WHEN k % 34 = 0 THEN {_NET} ELSE NULL END AS subtotal", "CASE WHEN k % 5 = 0 THEN NULL ELSE 20.5 END AS total_tax", f"CASE WHEN k % 3 = 0 THEN NULL ELSE {_NET} + 20.5 + CASE WHEN k % 19 = 0 THEN 90000.0 ELSE 0.0 END END AS total_gross",
    "CASE WHEN k % 3 = 0 THEN 10.0 ELSE NULL END AS total_freight", f"CASE WHEN k % 2 = 0 THEN {_NET} + CASE WHEN k % 5 = 0 THEN 0.0 ELSE 20.5 END + CASE WHEN k % 3 = 0 THEN 10.0 ELSE 0.0 END + CASE WHEN k % 23 = 0 THEN 80000.0 ELSE 0.0 END ELSE NULL END AS grand_total",
]


def lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_LINE)


def charges(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_CHARGE).where("n = 7").drop("n")


def orders(spark, sf):
    base = table(spark, sf, "orders").selectExpr(*_ORDER)
    net = lines(spark, sf).groupBy("doc_id").agg(F.sum(F.col("line_total").cast("decimal(18,2)")).cast("double").alias("a")).join(charges(spark, sf).groupBy("doc_id").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("b")), "doc_id", "left")
    rows = base.join(net, "doc_id", "left").withColumn("net", F.col("a") + F.coalesce("b", F.lit(0.0))).selectExpr("*", *_TOTAL)
    none = F.lit(None).cast("double")
    contact = F.array(F.struct(F.lit("buyer").alias("role"), F.lit("phone").alias("field"), F.col("phone").alias("value")))
    return rows.withColumns({"contacts": contact, "total_vat": none, "total_after_tax": none, "total_shipping": none, "total_surcharge": none, "total_discount": none, "rounding": none})


_L = f"SELECT {', '.join(_LINE)} FROM lineitem"
_C = f"SELECT * EXCLUDE n FROM (SELECT {', '.join(_CHARGE)} FROM lineitem) WHERE n = 7"
_O = f"""SELECT *, {', '.join(_TOTAL)} FROM (SELECT o.*, a + coalesce(b, 0.0::DOUBLE) AS net FROM (SELECT {', '.join(_ORDER)} FROM orders) o
LEFT JOIN (SELECT doc_id, CAST(sum(CAST(line_total AS DECIMAL(18,2))) AS DOUBLE) AS a FROM l GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS b FROM c GROUP BY 1) USING (doc_id))"""


def _close(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= greatest(0.03, 0.005 * greatest(abs({a}), abs({b}), 1))"


_BASE = f"""WITH l AS ({_L}), c AS ({_C}), o AS ({_O}),
q AS (SELECT *, try_cast(line_number AS BIGINT) AS num, last_value(try_cast(line_number AS BIGINT) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (quantity IS NOT NULL AND unit_price IS NOT NULL AND line_total IS NOT NULL) AS checked, count(*) FILTER ({_close('quantity * unit_price', 'line_total')}) AS valid,
 count(*) FILTER (quantity < 0) AS nq, count(*) FILTER (unit_price < 0) AS np, CAST(sum(CAST(line_total AS DECIMAL(18,2))) AS DOUBLE) AS product_sum, count(num) AS numbers, count(*) FILTER (num <= before) AS backward, count(*) FILTER (description LIKE 'SIRET%') AS footers,
 count(quantity) / count(*) AS rq, count(unit_price) / count(*) AS rp, count(line_total) / count(*) AS rt, max(currency) AS cur FROM q GROUP BY 1),
d AS (SELECT doc_id, count(*) AS dup FROM (SELECT doc_id FROM l GROUP BY doc_id, material, description, quantity, unit_price, line_total HAVING count(*) > 1) GROUP BY 1),
g AS (SELECT doc_id, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS charge_sum, count(*) AS cc, count(*) FILTER ({_close('quantity * unit_price', 'amount')}) AS cv FROM c GROUP BY 1),
j AS (SELECT o.*, s.* EXCLUDE doc_id, coalesce(dup, 0) AS dup, charge_sum, cc, cv, coalesce(total_net, subtotal) AS base FROM o LEFT JOIN s USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN g USING (doc_id)),
v AS (SELECT doc_id, number IS NOT NULL AS number_present, CASE WHEN number IS NOT NULL THEN number <> 'tel 0123' END AS number_type, CASE WHEN number = '0612345678' THEN false END AS contact_collision, n IS NOT NULL AS lines_present,
 CASE WHEN checked > 0 THEN checked = valid END AS quantity_price, CASE WHEN n > 0 THEN nq = 0 END AS negative_quantities, CASE WHEN n > 0 THEN np = 0 END AS negative_prices,
 CASE WHEN product_sum IS NOT NULL AND base IS NOT NULL THEN {_close('(product_sum + coalesce(charge_sum, 0.0::DOUBLE))', 'base')} END AS line_sum, CASE WHEN cc > 0 THEN cc = cv END AS charge_arithmetic,
 CASE WHEN base IS NOT NULL AND total_tax IS NOT NULL AND total_gross IS NOT NULL THEN {_close('(base + total_tax)', 'total_gross')} END AS tax_total,
 CASE WHEN grand_total IS NOT NULL AND base IS NOT NULL AND coalesce(total_tax, total_freight) IS NOT NULL THEN {_close('(base + coalesce(total_tax, 0) + coalesce(total_freight, 0))', 'grand_total')} END AS grand_total,
 CASE WHEN delivery_date IS NOT NULL THEN order_date <= delivery_date END AS date_consistency, cur IS NULL AND totals_currency = 'eur' AS currency_consistency, CASE WHEN numbers >= 2 THEN backward = 0 END AS number_sequence, CASE WHEN n > 0 THEN dup = 0 END AS duplicate_lines,
 k % 37 <> 0 AND supplier_name IS NOT NULL AND NOT (k % 4 = 0 AND k % 8 = 0) AND NOT (k % 4 = 3 AND k % 7 = 0) AS party_roles,
 CASE WHEN n > 0 THEN CASE k % 4 WHEN 0 THEN rq >= 0.8 AND rp >= 0.8 AND rt >= 0.8 WHEN 2 THEN rq >= 0.8 AND rp >= 0.8 ELSE true END END AS field_completeness,
 CASE k % 4 WHEN 0 THEN base IS NOT NULL WHEN 1 THEN base IS NOT NULL OR j.grand_total IS NOT NULL ELSE true END AS printed_total, CASE WHEN n > 0 THEN footers = 0 END AS legal_footer_lines FROM j)"""
_NAMES = ("number_present", "number_type", "contact_collision", "lines_present", "quantity_price", "negative_quantities", "negative_prices", "line_sum", "charge_arithmetic", "tax_total", "grand_total", "date_consistency", "currency_consistency", "number_sequence", "duplicate_lines", "party_roles", "field_completeness", "printed_total", "legal_footer_lines")
_FAILED = lambda names: "list_filter([" + ", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in names) + "], lambda x: x IS NOT NULL)"
_VALIDATED = f"""{_BASE}, w AS (SELECT *, {_FAILED(O.CRITICAL)} AS errors, {_FAILED([c for c in _NAMES if c not in O.CRITICAL])} AS warnings FROM v),
x AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'FAIL' WHEN len(warnings) > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM w)"""


@query(_VALIDATED + " SELECT * FROM x")
def order_checks(spark, sf):
    return O.validate(orders(spark, sf), lines(spark, sf), charges(spark, sf))


def _audited(spark, sf):
    rows = lines(spark, sf).selectExpr("*", "CASE WHEN k % 9 = 0 THEN unit_price * 0.9 ELSE NULL END AS net_unit_price", "CASE WHEN k % 11 = 0 THEN 100.0 ELSE NULL END AS price_unit", "CASE WHEN k % 7 = 0 THEN 5.0 ELSE NULL END AS adjustment")
    return O.audit_lines(rows).unionByName(O.audit_totals(orders(spark, sf))).unionByName(O.audit_addresses(addresses(spark, sf)))


_ADDRESS = [
    "s_suppkey AS ix", "CASE WHEN s_suppkey % 7 = 0 THEN '6900' WHEN s_suppkey % 11 = 0 THEN NULL ELSE '69000' END AS postal_code", "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Lyon' END AS city", "CASE WHEN s_suppkey % 3 = 0 THEN 'DE' ELSE 'fr' END AS country_code",
    "s_acctbal / 100.0 AS latitude", "s_acctbal / 50.0 AS longitude", "s_suppkey % 2 = 0 AS verified", "CASE s_suppkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'CONFIRMED' ELSE NULL END AS verification_status", "CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE 'index' END AS verification_provider",
    "CASE WHEN s_suppkey % 6 = 0 THEN '1 rue X, 69000 LYON, Lyon' ELSE '1 rue X, 69000 Lyonnais, Lyon' END AS formatted", "CASE s_suppkey % 5 WHEN 0 THEN 'ship_to' WHEN 1 THEN 'bill_to' WHEN 2 THEN 'Ship_To' WHEN 3 THEN 'unknown' ELSE 'supplier' END AS role",
    "CASE WHEN s_suppkey % 9 = 0 THEN 0.5 ELSE 0.9 END AS role_confidence", "CASE s_suppkey % 12 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'CLOSE_STREET_MATCH' WHEN 2 THEN 'DEPARTMENT_NOT_INDEXED' WHEN 3 THEN 'STREET_MATCH_NUMBER_NOT_FOUND' ELSE 'EXACT_MATCH' END AS reference_status",
]


def addresses(spark, sf):
    """The supplier's address block of every line, once an order."""
    of = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("ix")).distinct()
    return of.join(table(spark, sf, "supplier").selectExpr(*_ADDRESS), "ix")


_AUDIT = f"""a AS (SELECT doc_id, t.* FROM (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS ix FROM lineitem) JOIN (SELECT {', '.join(_ADDRESS)} FROM supplier) t USING (ix)),
m AS (SELECT *, CASE WHEN k % 9 = 0 THEN unit_price * 0.9 END AS net_p, CASE WHEN k % 11 = 0 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS basis, row_number() OVER (PARTITION BY doc_id, line_number ORDER BY ix) AS r FROM l),
i AS (SELECT doc_id, 'DUPLICATE_LINE_NUMBER' AS code, 'warning' AS severity, 'purchase_order.lines[' || (ix - 1) || '].line_number' AS path FROM m WHERE line_number IS NOT NULL AND r > 1
UNION ALL SELECT doc_id, 'LINE_AMOUNT_MISMATCH', 'warning', 'purchase_order.lines[' || (ix - 1) || ']' FROM m WHERE (net_p IS NOT NULL OR k % 7 <> 0) AND abs(quantity / 1 * coalesce(net_p, unit_price) / basis - line_total) > greatest(0.03, abs(quantity / basis) * 0.005 + 0.005)
UNION ALL SELECT doc_id, 'TOTAL_ARITHMETIC_MISMATCH', 'warning', 'purchase_order.totals' FROM o WHERE abs(coalesce(total_net, subtotal) + total_tax - coalesce(grand_total, total_gross)) > 0.05
UNION ALL SELECT doc_id, 'ADDRESS_DUPLICATE_CITY', 'warning', 'addresses[' || ix || '].formatted_address' FROM a WHERE city IS NOT NULL AND ix % 6 = 0
UNION ALL SELECT doc_id, 'FR_POSTAL_CODE_INVALID', 'warning', 'addresses[' || ix || '].address.postal_code' FROM a WHERE postal_code = '6900' AND country_code = 'fr'
UNION ALL SELECT doc_id, 'ADDRESS_CITY_MISSING', 'warning', 'addresses[' || ix || '].address.city' FROM a WHERE postal_code IS NOT NULL AND city IS NULL
UNION ALL SELECT doc_id, 'LATITUDE_OUT_OF_RANGE', 'error', 'addresses[' || ix || '].address.latitude' FROM a WHERE abs(latitude) > 90
UNION ALL SELECT doc_id, 'LONGITUDE_OUT_OF_RANGE', 'error', 'addresses[' || ix || '].address.longitude' FROM a WHERE abs(longitude) > 180
UNION ALL SELECT doc_id, 'VERIFICATION_STATUS_CONTRADICTION', 'error', 'addresses[' || ix || ']' FROM a WHERE verified AND verification_status IS NULL
UNION ALL SELECT doc_id, 'VERIFICATION_PROVIDER_MISSING', 'warning', 'addresses[' || ix || ']' FROM a WHERE verification_status IS NOT NULL AND verification_provider IS NULL)"""


@query(f"WITH l AS ({_L}), c AS ({_C}), o AS ({_O}), {_AUDIT} SELECT * FROM i")
def audit_issues(spark, sf):
    return _audited(spark, sf)


@query(f"""WITH l AS ({_L}), c AS ({_C}), o AS ({_O}), {_AUDIT}, p AS (SELECT doc_id, count(*) AS issue_count, count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count FROM i GROUP BY 1)
SELECT doc_id, coalesce(issue_count, 0) AS issue_count, coalesce(error_count, 0) AS error_count, coalesce(warning_count, 0) AS warning_count, CASE WHEN error_count > 0 THEN 'ERROR' WHEN warning_count > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM o LEFT JOIN p USING (doc_id)""")
def audit_quality(spark, sf):
    return O.quality(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")), _audited(spark, sf))


_GATED = f"""{_VALIDATED}, {_AUDIT}, po AS (SELECT o.*, x.status, x.contact_collision FROM o JOIN x USING (doc_id) WHERE document_type = 'purchase_order'),
ll AS (SELECT *, 'lines[' || (ix - 1) || ']' AS path FROM l SEMI JOIN po USING (doc_id)), aa AS (SELECT *, 'business_addresses[' || ix || ']' AS path FROM a SEMI JOIN po USING (doc_id)),
n AS (SELECT doc_id, count(*) FILTER (lower(role) = 'ship_to') AS ship, count(*) FILTER (role = 'bill_to') AS bill FROM a GROUP BY 1),
pn AS (SELECT po.*, coalesce(ship, 0) AS ship, coalesce(bill, 0) AS bill, doc_id IN (SELECT doc_id FROM l) AS lined FROM po LEFT JOIN n USING (doc_id)),
r AS (SELECT doc_id, 'ORDER_NUMBER_MISSING' AS code, 'purchase_order.number' AS path FROM pn WHERE number IS NULL UNION SELECT doc_id, 'ORDER_TOTAL_MISSING', 'totals.total_net' FROM pn WHERE total_net IS NULL
 UNION SELECT doc_id, 'PARTY_NAME_MISSING', 'supplier' FROM pn WHERE supplier_name IS NULL UNION SELECT doc_id, 'PARTY_NAME_UNINFORMATIVE', 'buyer' FROM pn WHERE buyer_name = 'SAS' UNION SELECT doc_id, 'PARTY_CONTACT_ROLE_CONFLICT', 'buyer/supplier.contact' FROM pn WHERE contact_collision = false
 UNION SELECT doc_id, 'ORDER_LINES_MISSING', 'lines' FROM pn WHERE NOT lined UNION SELECT doc_id, 'BUSINESS_VALIDATION_INCOMPLETE', 'validation' FROM pn WHERE status <> 'PASS' UNION SELECT doc_id, 'ADDRESS_ROLE_MISSING', 'business_addresses.ship_to' FROM pn WHERE ship = 0
 UNION SELECT doc_id, 'ADDRESS_ROLE_MISSING', 'business_addresses.bill_to' FROM pn WHERE bill = 0 UNION SELECT doc_id, 'DELIVERY_ADDRESS_AMBIGUOUS', 'business_addresses.ship_to' FROM pn WHERE ship > 1
 UNION SELECT doc_id, 'NOT_A_STRUCTURED_PURCHASE_ORDER', 'document' FROM o WHERE document_type = 'offer' UNION SELECT doc_id, 'PRODUCT_REFERENCE_MISSING', path FROM ll WHERE material IS NULL UNION SELECT doc_id, 'PRODUCT_REFERENCE_IMPLAUSIBLE', path || '.material_number' FROM ll WHERE k % 103 = 0
 UNION SELECT doc_id, 'QUANTITY_MISSING', path FROM ll WHERE quantity IS NULL UNION SELECT doc_id, 'LINE_TOTAL_MISSING', path FROM ll WHERE line_total IS NULL UNION SELECT doc_id, 'ADDRESS_ROLE_UNRESOLVED', path FROM aa WHERE role = 'unknown' UNION SELECT doc_id, 'ADDRESS_ROLE_UNCERTAIN', path FROM aa WHERE role_confidence < 0.8
 UNION SELECT doc_id, 'ADDRESS_LOCALITY_INCOMPLETE', path FROM aa WHERE postal_code IS NULL OR city IS NULL UNION SELECT doc_id, CASE reference_status WHEN 'NOT_FOUND' THEN 'ADDRESS_NOT_FOUND_IN_REFERENCE' WHEN 'CLOSE_STREET_MATCH' THEN 'ADDRESS_REFERENCE_SUGGESTION' WHEN 'DEPARTMENT_NOT_INDEXED' THEN 'ADDRESS_REFERENCE_UNAVAILABLE' ELSE 'ADDRESS_NUMBER_NOT_FOUND_IN_REFERENCE' END, path FROM aa WHERE reference_status <> 'EXACT_MATCH'
 UNION SELECT doc_id, code, path FROM i WHERE code <> 'ADDRESS_DUPLICATE_CITY')
SELECT doc_id, CASE WHEN count(code) > 0 THEN 'REVIEW_REQUIRED' ELSE 'CHECKS_PASSED' END AS decision, CAST(count(code) AS INT) AS n_reasons, coalesce(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), []) AS codes FROM o LEFT JOIN r USING (doc_id) GROUP BY doc_id"""


@query(_GATED)
def gate_decisions(spark, sf):
    rows = lines(spark, sf).withColumns({"reference": F.col("material"), "reference_status": F.when(F.col("k") % 103 == 0, "ALPHA_ONLY")})
    o = orders(spark, sf)
    return O.gate(o, rows, addresses(spark, sf), O.validate(o, lines(spark, sf), charges(spark, sf)), _audited(spark, sf))


_READ_TWICE = [*_LINE, "CAST(l_partkey % 2 AS INT) AS page", "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'S1' END AS supplier_material"]


@query(f"""WITH t AS (SELECT {', '.join(_READ_TWICE)} FROM lineitem), u AS (SELECT * FROM t UNION ALL SELECT * REPLACE (ix + 100 AS ix, upper(description) AS description) FROM t WHERE k % 3 = 0 UNION ALL SELECT * REPLACE (ix + 200 AS ix, 'Suite page 2' AS description) FROM t WHERE k % 10 = 0),
f AS (SELECT * FROM u WHERE description <> 'Suite page 2' QUALIFY row_number() OVER (PARTITION BY doc_id, page, coalesce(line_number, ''), coalesce(material, ''), coalesce(supplier_material, ''), lower(description), quantity, unit_price, line_total ORDER BY ix) = 1)
SELECT doc_id, ix, coalesce(line_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS VARCHAR)) AS line_number, description FROM f""")
def line_dedupe_signature(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr(*_READ_TWICE)
    again = t.where("k % 3 = 0").withColumns({"ix": F.col("ix") + 100, "description": F.upper("description")})
    marks = t.where("k % 10 = 0").withColumns({"ix": F.col("ix") + 200, "description": F.lit("Suite page 2")})
    return O.dedupe_lines(t.unionByName(again).unionByName(marks)).select("doc_id", "ix", "line_number", "description")


@query(f"""WITH l AS ({_L}), b AS (SELECT doc_id, ix, CASE WHEN k % 3 = 0 THEN line_number END AS own FROM l),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, i FROM (SELECT DISTINCT doc_id FROM l), (SELECT unnest(range(1, 100)) AS i) EXCEPT SELECT doc_id, CAST(own AS BIGINT) FROM b WHERE own IS NOT NULL)),
m AS (SELECT *, CASE WHEN own IS NULL THEN count(*) FILTER (own IS NULL) OVER (PARTITION BY doc_id ORDER BY ix) END AS n FROM b)
SELECT m.doc_id, m.ix, coalesce(own, CAST(f.i AS VARCHAR)) AS line_number FROM m LEFT JOIN f ON f.doc_id = m.doc_id AND f.n = m.n""")
def line_renumbering(spark, sf):
    return O.renumber(lines(spark, sf)).select("doc_id", "ix", "line_number")


@query(f"""WITH l AS ({_L}) SELECT doc_id, CASE WHEN k % 61 = 0 THEN 'quote_note_as_product' WHEN k % 67 = 0 THEN 'date_footer_as_product' ELSE 'non_commercial_fragment' END AS reason, count(*) AS n
FROM l WHERE k % 61 = 0 OR k % 67 = 0 OR ((quantity IS NULL) AND k % 2 = 0) GROUP BY ALL""")
def non_product_lines(spark, sf):
    rows = lines(spark, sf).withColumns({"material": F.when(F.col("k") % 61 == 0, "Devis").when(F.col("k") % 67 == 0, "12/05/2024").otherwise(F.col("material")), "raw_text": F.when(F.col("k") % 67 == 0, "Total HT 12").otherwise(F.lit("")), "supported": F.col("k") % 2 == 1})
    return O.rejected_counts(rows)


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) + 0.5 END AS net, CAST(o_custkey AS DOUBLE) * 2 AS gross FROM orders""")
def totals_of_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    k = F.col("o_custkey").cast("string")
    texts = F.array(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Total H.T. "), k, F.lit("0,99"))), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("TOTAL HT : "), k, F.lit(",50 €"))), F.lit("Pompe 12,00"), F.concat(F.lit("Net à payer "), (F.col("o_custkey") * 2).cast("string")))
    rows = o.select("doc_id", F.posexplode(texts).alias("ix", "text")).where("text IS NOT NULL")
    return O.totals_from_rows(rows, {"net": r"\btotal h\.?t\b", "gross": r"\bnet a payer\b"})


@query("""SELECT l_orderkey AS doc_id, CAST(min(l_shipdate) AS DATE) AS delivery_date FROM lineitem GROUP BY 1 HAVING min(CAST(l_shipdate AS DATE)) = max(CAST(l_shipdate AS DATE))""")
def uniform_delivery_dates(spark, sf):
    return O.uniform_date(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.to_date("l_shipdate").alias("delivery_date")))
