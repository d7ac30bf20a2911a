"""Queries of annotations and of the published form of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import contract as C
from ..operators import scoring
from .probes import probe
from .registry import query, table

#: The lines of an order as annotated fields; every few break a rule.
_FIELD = [
    "l_orderkey AS doc_id", "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS ix", "l_partkey AS k",
    "CASE l_suppkey % 4 WHEN 0 THEN 'LINE_ITEM_QUANTITY' WHEN 1 THEN 'TOTAL_NET' WHEN 2 THEN 'CHARGE_AMOUNT' ELSE 'LINE_ITEM_PRICE' END AS label",
    "CASE WHEN l_partkey % 7 = 0 THEN 'totals.net' WHEN l_suppkey % 4 = 2 THEN concat('order.additional_charges[', CAST(l_linenumber % 2 AS STRING), '].amount') WHEN l_suppkey % 4 = 1 THEN 'totals.net' ELSE concat('order.lines[', CAST(l_linenumber AS STRING), '].x') END AS path",
]
_F = f"SELECT {', '.join(_FIELD)} FROM lineitem"
_INDEXED = f"SELECT *, CAST(nullif(regexp_extract(path, 'lines\\[([0-9]+)\\]', 1), '') AS INT) AS line, CAST(nullif(regexp_extract(path, 'additional_charges\\[([0-9]+)\\]', 1), '') AS INT) AS charge FROM ({_F})"


def _fields(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_FIELD)


@query(f"""WITH f AS ({_INDEXED}), g AS (SELECT doc_id, count(*) FILTER (label LIKE 'LINE%' AND line IS NULL) AS a, count(*) FILTER (label NOT LIKE 'LINE%' AND line IS NOT NULL) AS b, count(*) FILTER (label LIKE 'CHARGE%' AND charge IS NULL) AS c, count(*) FILTER (label NOT LIKE 'CHARGE%' AND charge IS NOT NULL) AS d, coalesce(max(line) + 1, 0) - count(DISTINCT line) AS e FROM f GROUP BY 1),
h AS (SELECT doc_id, sum(n - 1) AS more FROM (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id, label, CASE WHEN label LIKE 'LINE%' THEN 'l' || line WHEN label LIKE 'CHARGE%' THEN 'c' || charge END) GROUP BY 1),
u AS (SELECT doc_id, unnest([{{fault: 'line label outside lines', n: a}}, {{fault: 'other label in a line', n: b}}, {{fault: 'charge label outside charges', n: c}}, {{fault: 'other label in a charge', n: d}}, {{fault: 'missing line indexes', n: e}}, {{fault: 'duplicate labels', n: CAST(more AS BIGINT)}}]) AS x FROM g JOIN h USING (doc_id))
SELECT doc_id, x.fault, x.n FROM u WHERE x.n > 0""")
def annotation_structure(spark, sf):
    return A.structure_faults(_fields(spark, sf))


@query(f"SELECT doc_id, ix, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line IS NOT NULL, line, ix) - 1 AS INT) AS place FROM ({_INDEXED})")
def annotation_order(spark, sf):
    return A.lines_last(_fields(spark, sf)).select("doc_id", "ix", "place")


@query(f"SELECT doc_id, ix, CASE WHEN line IS NULL THEN path ELSE 'order.line_items[' || (dense_rank() OVER (PARTITION BY doc_id, line IS NULL ORDER BY line) - 1) || '].x' END AS path FROM ({_INDEXED})")
def annotation_line_paths(spark, sf):
    return A.compact_lines(_fields(spark, sf)).select("doc_id", "ix", "path")


def _regions(spark, sf):
    f = _fields(spark, sf)
    x = (F.col("k") % 4 * 30).cast("double")
    return f.withColumns({"page": F.lit(1), "text": F.concat(F.lit("T"), (F.col("k") % 3).cast("string")), "x0": x, "y0": F.lit(0.0), "x1": x + 40, "y1": F.lit(10.0)})


@query(f"""WITH f AS (SELECT *, k % 4 * 30 AS x FROM ({_F})) SELECT a.doc_id, 1 AS page, a.ix AS a, b.ix AS b, CASE WHEN a.k % 3 = b.k % 3 THEN 'AMBIGUOUS_LABEL' ELSE 'CROSSING_REGIONS' END AS code FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.ix < b.ix AND a.label <> b.label AND abs(a.x - b.x) < 40""")
def annotation_region_conflicts(spark, sf):
    return A.region_conflicts(_regions(spark, sf))


@query(f"""WITH f AS (SELECT *, k % 4 * 30 AS x FROM ({_F})) SELECT a.doc_id, a.ix AS a, b.ix AS b FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.ix < b.ix AND a.label <> b.label AND abs(a.x - b.x) < 40 WHERE a.k % 5 = 0 OR b.k % 5 = 0""")
def annotation_new_conflicts(spark, sf):
    """Conflicts that fields of every fifth part bring to the others."""
    r = _regions(spark, sf)
    return A.new_conflicts(A.region_conflicts(r.where("k % 5 <> 0")), A.region_conflicts(r)).select("doc_id", "a", "b")


@query(f"""WITH f AS (SELECT *, label AS l, 'v' || (k % 3) AS v, k % 2 = 0 AS exact, k % 5 = 0 AS evidence, (k % 7) / 10.0 AS confidence FROM ({_F})), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, v ORDER BY exact DESC, evidence DESC, confidence DESC, ix) AS n, min(ix) OVER (PARTITION BY doc_id, label, v) AS place FROM f)
SELECT doc_id, label, place, ix, CAST(confidence AS DOUBLE) AS confidence FROM r WHERE n = 1""")
def annotation_candidates(spark, sf):
    value = F.when(F.col("k") % 2 == 0, F.concat(F.lit("V "), (F.col("k") % 3).cast("string"))).otherwise(F.concat(F.lit("v"), (F.col("k") % 3).cast("string")))
    rows = _fields(spark, sf).withColumns({"grp": F.lit("g"), "value": value, "exact": F.col("k") % 2 == 0, "evidence": F.col("k") % 5 == 0, "confidence": (F.col("k") % 7) / 10.0})
    return A.best_candidates(rows).select("doc_id", "label", "place", "ix", "confidence")


@query("""WITH d AS (SELECT doc_id, source AS family, lang AS stratum, sha256(text) AS digest, sha256('s' || chr(0) || doc_id) AS rank FROM documents), o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY digest ORDER BY rank) = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY family, stratum ORDER BY rank) AS s FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY s, rank) AS f FROM a)
SELECT doc_id, family, stratum FROM b ORDER BY f, s, rank LIMIT 25""")
def varied_sample(spark, sf):
    return A.varied(table(spark, sf, "documents").select("doc_id", F.col("source").alias("family"), F.col("lang").alias("stratum"), F.sha2("text", 256).alias("digest")), 25, "s")


@query("""WITH d AS (SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'f' || c_custkey WHEN 1 THEN 'A_f' || c_custkey WHEN 2 THEN 'same' ELSE 'g' || c_custkey END AS name, CASE WHEN c_custkey % 4 = 3 THEN ' ' ELSE 'A' END AS client FROM customer)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'RENAME' WHEN 1 THEN 'ALREADY_PREFIXED' WHEN 2 THEN 'CLASH' ELSE 'NO_CLIENT' END AS verdict, CASE WHEN doc_id % 4 = 0 THEN 'A_' || name ELSE name END AS name FROM d""")
def rename_plan(spark, sf):
    k = F.col("c_custkey")
    key = k.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("f"), key)).when(k % 4 == 1, F.concat(F.lit("A_f"), key)).when(k % 4 == 2, "same").otherwise(F.concat(F.lit("g"), key))
    return A.rename_plan(table(spark, sf, "customer").select(k.alias("doc_id"), name.alias("name"), F.when(k % 4 == 3, " ").otherwise("A").alias("client")))


probe("page_buckets", {"bucket": lambda x: A.page_bucket(F.length(x))}, [("", "1"), ("a", "1"), ("abc", "2-3"), ("abcd", "4+")])

probe("localities", {"postal_code": lambda x: C.locality(F.lit("69000"), x)["postal_code"], "city": lambda x: C.locality(F.lit("69000"), x)["city"], "routing": lambda x: C.locality(F.lit("69000"), x)["postal_routing_code"]}, [
    ("Lyon", "69000", "Lyon", None), ("69000 Lyon", "69000", "Lyon", None), ("13001 Marseille", "13001", "Marseille", "69000"), ("Lyon Lyon", "69000", "Lyon", None), ("", "69000", None, None),
])


def _published(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey < 400")
    key = F.col("o_orderkey").cast("string")
    number = C.field(F.concat(F.lit(" PO  "), key, F.lit(" ")), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("PO "), key)), F.lit(0.9), F.lit(None).cast("string"), F.lit(1), F.lit("Commande"), F.lit(None).cast("string"))
    buyer = C.contact(F.lit(" "), F.when(F.col("o_custkey") % 2 == 0, "own@x.fr"), F.lit("123"), F.lit(None).cast("string"), F.lit("nested@x.fr"), F.lit("01 02 03 04 05"), F.lit("01 02 03 04 06"))
    orders = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("f"), key, F.lit(".pdf")).alias("filename"), number.alias("number"), buyer.alias("buyer"))
    item = table(spark, sf, "lineitem").where("l_orderkey < 400").selectExpr("l_orderkey AS doc_id", "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS ix", "l_quantity AS q", "l_extendedprice AS line_total", "l_partkey AS k")
    none = F.lit(None).cast("string")
    lines = item.withColumns({"line_number": F.col("ix").cast("string"), "material": none, "ean": none, "description": F.lit("Tube 30 x Z5 mm"), "quantity": F.when(F.col("k") % 2 == 0, F.col("q")), "ordered_quantity": F.lit(7.0), "uom": none, "unit_price": F.lit(None).cast("double"), "net_unit_price": F.lit(1.5), "currency": F.lit("EUR"), "requested_date": none, "delivery_date": F.lit("2024-01-02"), "status": none, "page": F.lit(1)})
    charges = item.where("ix = 1").select("doc_id", "ix", F.lit("shipping").alias("charge_type"), F.lit("Port").alias("description"), F.lit(" ").alias("supplier_reference"), F.lit("P1").alias("code"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("double").alias("unit_price"), F.lit(12.5).alias("amount"), F.lit(None).cast("string").alias("currency"))
    return C.published(orders, C.line(lines), C.charge(charges))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_quantity AS q, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS ix FROM lineitem WHERE l_orderkey < 400), a AS (SELECT doc_id, count(*) AS lines, arg_min(CASE WHEN k % 2 = 0 THEN q ELSE 7.0 END, ix) AS q FROM l GROUP BY 1)
SELECT o_orderkey AS doc_id, 'PO ' || o_orderkey AS number, CASE WHEN o_orderkey % 2 = 1 THEN ' PO  ' || o_orderkey || ' ' END AS raw, 'Commande' AS source, CASE WHEN o_custkey % 2 = 0 THEN 'own@x.fr' ELSE 'nested@x.fr' END AS email, CAST(NULL AS VARCHAR) AS phone, '01 02 03 04 06' AS fax, coalesce(lines, 0) AS lines, q AS quantity, CASE WHEN lines > 0 THEN 'Tube 30X25 mm' END AS description, CASE WHEN lines > 0 THEN '2024-01-02' END AS day, CASE WHEN lines > 0 THEN 'P1' END AS charge FROM orders LEFT JOIN a ON doc_id = o_orderkey WHERE o_orderkey < 400""")
def published_contract(spark, sf):
    """The contract's JSON read again: empty parts are gone, a raw value stays only where it differs."""
    at = lambda path: F.get_json_object("json", path)
    lines = F.coalesce(F.json_array_length(at("$.lines")), F.lit(0)).cast("long")
    return _published(spark, sf).select("doc_id", at("$.order.number.value").alias("number"), at("$.order.number.raw_value").alias("raw"), at("$.order.number.evidence.source_text").alias("source"), at("$.order.buyer.email").alias("email"), at("$.order.buyer.phone").alias("phone"), at("$.order.buyer.fax").alias("fax"), lines.alias("lines"), at("$.lines[0].quantity").cast("double").alias("quantity"), at("$.lines[0].description").alias("description"), at("$.lines[0].delivery.date").alias("day"), at("$.charges[0].reference").alias("charge"))


@query("SELECT c_custkey AS doc_id, '3.0' AS version, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_custkey ELSE 'kept' END AS number, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS buyer FROM customer")
def upgraded_contract(spark, sf):
    old = F.concat(F.lit('{"schema_version":"2.0","filename":"f","order_number":"N'), F.col("c_custkey").cast("string"), F.lit('","buyer_name":"'), "c_name", F.lit('"}'))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, old).otherwise('{"schema_version":"3.0","order":{"number":{"value":"kept"}}}').alias("json"))
    at = lambda path: F.get_json_object("json", path)
    return C.upgraded(rows).select("doc_id", at("$.schema_version").alias("version"), at("$.order.number.value").alias("number"), at("$.order.buyer.name").alias("buyer"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('d:' || doc_id), doc_id) - 1 AS n, count(*) OVER () AS total FROM documents), s AS (SELECT doc_id, CASE WHEN n < held THEN 'test' WHEN n < 2 * held THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, greatest(1, CAST(round_even(total * 0.15::DOUBLE, 0) AS BIGINT)) AS held FROM r)),
f AS (SELECT doc_id, count(*) AS fields FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 3 <> 0) GROUP BY 1)
SELECT split, count(*) AS documents, CAST(sum(fields) AS BIGINT) AS fields FROM f JOIN s USING (doc_id) GROUP BY 1""")
def dataset_statistics(spark, sf):
    d = table(spark, sf, "documents")
    annotations = d.where("doc_id % 3 <> 0").select("doc_id", F.explode(F.split("text", "\n")).alias("payload"))
    return C.dataset(d, scoring.ranked_splits(d, "d"), annotations)[1]
