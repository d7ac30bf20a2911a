"""Queries of the scalar functions. Their inputs are printed forms of the tables' values, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses, boxes, identifiers, numbers
from ..functions import text as T
from .registry import query, table

#: An account balance in five notations.
_CENTS = "abs(CAST(round(c_acctbal * 100) AS BIGINT))"
_WHOLE = f"CAST(floor({_CENTS} / 100) AS BIGINT)"
_THOUSANDS = f"CAST(CAST(floor({_CENTS} / 100000) AS BIGINT) AS VARCHAR(20))"
_UNITS = f"lpad(CAST({_WHOLE} % 1000 AS VARCHAR(20)), 3, '0')"
_FRACTION = f"lpad(CAST({_CENTS} % 100 AS VARCHAR(20)), 2, '0')"
_PRINTED = f"""concat(CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END, CASE c_custkey % 5 WHEN 0 THEN concat(CAST({_WHOLE} AS VARCHAR(20)), ',', {_FRACTION}, ' €')
WHEN 1 THEN concat({_THOUSANDS}, '.', {_UNITS}, ',', {_FRACTION}) WHEN 2 THEN concat(CAST({_WHOLE} AS VARCHAR(20)), '.', {_FRACTION})
WHEN 3 THEN concat({_THOUSANDS}, ' ', {_UNITS}, ',', {_FRACTION}) ELSE concat({_THOUSANDS}, ',', {_UNITS}, '.', {_FRACTION}) END)"""
_BRACKETS = f"CASE WHEN c_acctbal < 0 THEN concat('(', substr({_PRINTED}, 2), ')') ELSE {_PRINTED} END"


@query(f"SELECT c_custkey, {_PRINTED} AS printed, CAST(round(c_acctbal * 100) AS BIGINT) / 100 AS amount FROM customer")
def money_parse(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.expr(_PRINTED).alias("printed")).withColumn("amount", numbers.money(F.col("printed")))


@query(f"SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) / 100 AS amount FROM customer")
def accounting_number_parse(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numbers.accounting(F.expr(_BRACKETS)).alias("amount"))


_LONG = f"concat(CAST({_WHOLE} AS VARCHAR(20)), ',', {_FRACTION}, '000')"


@query(f"SELECT c_custkey, {_CENTS} / 100 AS price FROM customer")
def native_decimal_prices(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numbers.native_decimal(F.expr(_LONG)).alias("price"))


_CELL = "concat(CAST(p_size AS VARCHAR(20)), CASE p_partkey % 5 WHEN 0 THEN ' PCS' WHEN 1 THEN ',5 kg' WHEN 2 THEN '' WHEN 3 THEN ' / 12' ELSE 'm.' END)"


@query(f"""SELECT p_partkey, {_CELL} AS cell, CASE p_partkey % 5 WHEN 1 THEN p_size + 0.5::DOUBLE WHEN 3 THEN NULL ELSE p_size::DOUBLE END AS quantity,
CASE p_partkey % 5 WHEN 0 THEN 'PCE' WHEN 1 THEN 'KG' WHEN 4 THEN 'M' END AS unit FROM part""")
def quantity_cells(spark, sf):
    cell = table(spark, sf, "part").select("p_partkey", F.expr(_CELL).alias("cell"))
    return cell.withColumns({"quantity": numbers.cell_number(F.col("cell")), "unit": numbers.cell_unit(F.col("cell"))})


@query("""SELECT event_type, count(*) AS n, CASE WHEN count(*) = 1 THEN 1 WHEN count(*) = 2 THEN 1 ELSE count(*) - 2 * greatest(1, CAST(round_even(count(*) * 0.15::DOUBLE, 0) AS BIGINT)) END AS train,
CASE WHEN count(*) = 1 THEN 0 ELSE greatest(1, CAST(round_even(count(*) * 0.15::DOUBLE, 0) AS BIGINT)) END AS validation,
CASE WHEN count(*) < 3 THEN 0 ELSE greatest(1, CAST(round_even(count(*) * 0.15::DOUBLE, 0) AS BIGINT)) END AS test FROM events GROUP BY 1""")
def training_split_sizes(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("s", numbers.split_sizes(F.col("n"))).select("event_type", "n", "s.*")


_REF = """CASE p_partkey % 6 WHEN 0 THEN concat('8-703-', lpad(CAST(p_partkey AS VARCHAR(20)), 6, '0')) WHEN 1 THEN concat(' t0', lpad(CAST(p_partkey AS VARCHAR(20)), 7, '0'), 'a ')
WHEN 2 THEN concat('77', lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0'), '/LM') WHEN 3 THEN concat('AB 12 ', CAST(p_partkey AS VARCHAR(20))) WHEN 4 THEN concat('[', p_brand, ']') ELSE concat('12.5 x ', CAST(p_size AS VARCHAR(20))) END"""


@query(f"""WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '8703' || lpad(p_partkey::VARCHAR, 6, '0') WHEN 1 THEN 'T0' || lpad(p_partkey::VARCHAR, 7, '0') || 'A'
WHEN 2 THEN '77' || lpad(p_partkey::VARCHAR, 8, '0') WHEN 3 THEN 'AB12' || p_partkey WHEN 4 THEN upper(p_brand) ELSE '12.5 X ' || p_size END AS reference FROM part),
s AS (SELECT *, regexp_extract_all(reference, '[0-9]+|[A-Z]+|[^0-9A-Z]+') AS runs FROM r)
SELECT p_partkey, reference, array_to_string(list_transform(runs, lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'D' WHEN regexp_matches(x, '^[A-Z]') THEN 'A' ELSE 'S' END || length(x)), '-') AS runs,
CASE WHEN regexp_full_match(reference, '[0-9]+') THEN 'digits_only' WHEN regexp_matches(reference, '[A-Z]') THEN 'contains_letter' ELSE 'other' END AS kind FROM s""")
def reference_normal_forms(spark, sf):
    ref = table(spark, sf, "part").select("p_partkey", identifiers.reference(F.expr(_REF)).alias("reference"))
    return ref.withColumns({"runs": identifiers.reference_runs(F.col("reference")), "kind": identifiers.reference_kind(F.col("reference"))})


_SHAPED = r"""WITH c AS (SELECT doc_id, i, CASE WHEN regexp_matches(ch, '\p{Lu}') THEN 'X' WHEN regexp_matches(ch, '\p{Ll}') THEN 'x' WHEN regexp_matches(ch, '\p{Nd}') THEN 'd' ELSE ch END AS m
FROM (SELECT conv_id * 1000 + turn AS doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM conversations)),
k AS (SELECT doc_id, i, m FROM c QUALIFY m IS DISTINCT FROM lag(m) OVER (PARTITION BY doc_id ORDER BY i))
SELECT conv_id * 1000 + turn AS doc_id, coalesce(shape, '') AS shape FROM conversations LEFT JOIN (SELECT doc_id, substr(string_agg(m, '' ORDER BY i), 1, 16) AS shape FROM k GROUP BY 1) s ON s.doc_id = conv_id * 1000 + turn WHERE text IS NOT NULL"""


@query(_SHAPED)
def character_shapes(spark, sf):
    return table(spark, sf, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), identifiers.character_shape(F.col("text")).alias("shape"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b', ' <date> ', 'g'), '\b\d+[.,]\d{2}\b', ' <amount> ', 'g'), '\b\d{8,}\b', ' <longnum> ', 'g')) AS replaced_sha FROM documents""")
def text_placeholders(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(identifiers.placeholders(F.col("text")), 256).alias("replaced_sha"))


_CODE = "concat(CASE c_custkey % 3 WHEN 0 THEN 'CLI' WHEN 1 THEN 'BOSCH' ELSE '9X' END, translate(lpad(CAST(c_custkey AS VARCHAR(20)), 5, '0'), '01258', 'OIZSB'))"


@query(f"SELECT c_custkey, {_CODE} AS printed, CASE c_custkey % 3 WHEN 2 THEN {_CODE} ELSE regexp_extract({_CODE}, '^([A-Z]{{2,8}})([0-9OILZSB]{{3,12}})$', 1) || translate(regexp_extract({_CODE}, '^([A-Z]{{2,8}})([0-9OILZSB]{{3,12}})$', 2), 'OILZSB', '011258') END AS code FROM customer")
def party_code_repair(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.expr(_CODE).alias("printed")).withColumn("code", identifiers.party_code(F.col("printed")))


_SIZE = "concat(p_name, ' ', CAST(p_size AS VARCHAR(20)), CASE p_partkey % 3 WHEN 0 THEN ' x Z5 MM' WHEN 1 THEN 'XZ40' ELSE ' Z12' END)"


@query("SELECT p_partkey, p_name || ' ' || p_size || CASE p_partkey % 3 WHEN 0 THEN 'X25 MM' WHEN 1 THEN 'X240' ELSE ' Z12' END AS description FROM part")
def dimension_repair(spark, sf):
    return table(spark, sf, "part").select("p_partkey", identifiers.dimensions(F.expr(_SIZE)).alias("description"))


_TWICE = "concat(p_name, ' ', p_name, ' - - ', p_type, ' ', CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_brand END, ' ,')"


@query(f"""WITH w AS (SELECT p_partkey, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT p_partkey, string_split({_TWICE}, ' ') AS t FROM part)),
k AS (SELECT *, regexp_replace(upper(token), '[^A-Z0-9]+', '', 'g') AS key FROM w), b AS (SELECT *, sum((key IS DISTINCT FROM prev OR (key = '' AND token IS DISTINCT FROM before))::INT) OVER (PARTITION BY p_partkey ORDER BY i) AS run
FROM (SELECT *, lag(key) OVER (PARTITION BY p_partkey ORDER BY i) AS prev, lag(token) OVER (PARTITION BY p_partkey ORDER BY i) AS before FROM k)),
n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, run ORDER BY i) AS place FROM b)
SELECT p_partkey, trim(string_agg(token, ' ' ORDER BY i), ' ,;|') AS cleaned FROM n WHERE (key <> '' AND place % 2 = 1) OR (key = '' AND (token <> '-' OR place = 1)) GROUP BY 1""")
def repeated_token_cleanup(spark, sf):
    return table(spark, sf, "part").select("p_partkey", identifiers.without_repeats(F.expr(_TWICE)).alias("cleaned"))


_PHONE = """CASE c_custkey % 6 WHEN 0 THEN concat('0', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '4')) WHEN 1 THEN concat('+49 30 ', lpad(CAST(c_custkey AS VARCHAR(20)), 7, '1')) WHEN 2 THEN lpad(CAST(c_custkey AS VARCHAR(20)), 9, '5')
WHEN 3 THEN concat('01 02 03 04 ', CAST(c_custkey % 90 + 10 AS VARCHAR(20))) WHEN 4 THEN '00000000000' ELSE concat('555-867-', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0')) END"""


@query(f"SELECT c_custkey, {_PHONE} AS phone, CASE WHEN c_custkey % 6 IN (0, 1, 3) THEN {_PHONE} END AS kept, c_custkey % 6 IN (0, 1, 3, 5) AS plausible FROM customer")
def phone_checks(spark, sf):
    phone = table(spark, sf, "customer").select("c_custkey", F.expr(_PHONE).alias("phone"))
    return phone.withColumns({"kept": identifiers.kept_phone(F.col("phone")), "plausible": identifiers.plausible_phone(F.col("phone"))})


_NUMBER = """CASE o_orderkey % 6 WHEN 0 THEN concat('PO-', CAST(o_orderkey AS VARCHAR(20)), '/26') WHEN 1 THEN CAST(45000000 + o_orderkey AS VARCHAR(20)) WHEN 2 THEN concat('Total ', CAST(o_orderkey AS VARCHAR(20)))
WHEN 3 THEN 'Reprise le 05 Janvier 2026' WHEN 4 THEN '01 02 03 04 05' ELSE concat('achat@firma', CAST(o_orderkey AS VARCHAR(20)), '.de') END"""


@query(f"SELECT o_orderkey, {_NUMBER} AS number, o_orderkey % 6 > 1 AS rejected FROM orders")
def order_number_guard(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(_NUMBER).alias("number")).withColumn("rejected", identifiers.bad_order_number(F.col("number")))


_ROW = "CASE l_linenumber WHEN 1 THEN concat('Page ', CAST(l_quantity AS INT)) WHEN 2 THEN 'Suite page 2/3' WHEN 3 THEN 'Continued on page 4' ELSE concat('Page of ', l_returnflag) END"


@query("SELECT l_orderkey, l_linenumber, l_linenumber <= 3 AS continues FROM lineitem")
def continuation_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", identifiers.continuation_row(F.expr(_ROW)).alias("continues"))


_STREET = "concat(CASE c_custkey % 4 WHEN 0 THEN 'av. ' WHEN 1 THEN 'Bd ' WHEN 2 THEN 'rue de l''' ELSE 'ZA ' END, c_name)"
_CODE5 = "CASE c_custkey % 4 WHEN 0 THEN '20100' WHEN 1 THEN '97400' WHEN 2 THEN concat('75', lpad(CAST(c_custkey % 1000 AS VARCHAR(20)), 3, '0')) ELSE 'F-100' END"
_PART_SQL = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 7, '0') AS house, CASE c_custkey % 4 WHEN 0 THEN 'AVENUE ' WHEN 1 THEN 'BOULEVARD ' WHEN 2 THEN 'RUE DE L ' ELSE 'ZONE ACTIVITE ' END || {_PART_SQL.format('c_name')} AS street, {_CODE5} AS postal_code, {_PART_SQL.format('c_mktsegment')} AS city FROM customer)
SELECT c_custkey, street, CASE c_custkey % 4 WHEN 0 THEN ['2A', '2B'] WHEN 1 THEN ['974'] WHEN 2 THEN ['75'] ELSE [] END AS departments,
CASE WHEN c_custkey % 4 < 3 THEN substr(sha256(concat_ws(chr(31), house::BIGINT::VARCHAR, '', street, postal_code, city)), 1, 32) END AS key FROM a""")
def canonical_address_keys(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", F.expr(_STREET).alias("street"), F.expr(_CODE5).alias("code"), F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("house"), F.col("c_mktsegment").alias("city"))
    key = addresses.key(F.col("house"), F.lit(""), F.col("street"), F.col("code"), F.col("city"))
    return a.select("c_custkey", addresses.part(F.col("street")).alias("street"), addresses.departments(F.col("code")).alias("departments"), key.alias("key"))


_TOWN = "concat(c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN concat(' Cedex ', CAST(c_custkey % 20 AS VARCHAR(20))) WHEN 1 THEN ' - CEDEX' ELSE '' END)"


@query("SELECT c_custkey, c_mktsegment AS city, CASE WHEN c_custkey % 3 < 2 THEN true END AS cedex, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 20)::VARCHAR END AS cedex_number FROM customer")
def city_cedex_split(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", addresses.town(F.expr(_TOWN)).alias("t")).select("c_custkey", "t.*")


@query("""WITH a AS (SELECT s_suppkey, s_name || ', ' || n_name || CASE WHEN s_suppkey % 2 = 0 THEN ', FRANCE' ELSE '' END AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, label, substr(sha1(regexp_replace(lower(label), '[^a-z0-9]', '', 'g')), 1, 12) AS fingerprint FROM a""")
def address_labels(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    label = addresses.label(F.col("s_name"), F.lit(None).cast("string"), F.upper("s_name"), F.concat(F.col("n_name"), F.lit("  ")), F.when(F.col("s_suppkey") % 2 == 0, "FRANCE"), F.lower("n_name"))
    return s.select("s_suppkey", label.alias("label")).withColumn("fingerprint", addresses.fingerprint(F.col("label")))


_BOX = "l_orderkey, l_linenumber, l_partkey, l_quantity AS x0, l_tax * 1000 AS y0, l_quantity + 20 AS x1, l_tax * 1000 + 30 AS y1, l_quantity + 5 AS t0, l_discount * 500 AS u0, l_quantity + 22 AS t1, l_discount * 500 + 40 AS u1"


@query(f"""WITH b AS (SELECT {_BOX} FROM lineitem), c AS (SELECT *, greatest(0, least(x1, t1) - greatest(x0, t0)) * greatest(0, least(y1, u1) - greatest(y0, u0)) AS inside, (x1 - x0) * (y1 - y0) AS a, (t1 - t0) * (u1 - u0) AS t FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, round(inside / (a + t - inside), 9) AS iou, round(inside / t, 9) AS coverage, round(greatest(0, (a - inside) / a), 9) AS contamination,
x0 - 1.5 <= t0 AND y0 - 1.5 <= u0 AND x1 + 1.5 >= t1 AND y1 + 1.5 >= u1 AS holds, greatest(0, x0 - 4) AS px0, least(60, x1 + 4) AS px1 FROM c""")
def box_measures(spark, sf):
    b = table(spark, sf, "lineitem").selectExpr(*(x.strip() for x in _BOX.split(",")))
    p, t = boxes.box(), tuple(F.col(c) for c in ("t0", "u0", "t1", "u1"))
    wide = boxes.padded(p, 4.0, 2.0, 60.0, 200.0)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", F.round(boxes.iou(p, t), 9).alias("iou"), F.round(boxes.coverage(p, t), 9).alias("coverage"), F.round(boxes.contamination(p, t), 9).alias("contamination"), boxes.contains(p, t).alias("holds"), wide[0].alias("px0"), wide[2].alias("px1"))


@query("SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"props\":' || to_json(props) || ',\"user_id\":' || user_id || '}') AS digest FROM events")
def canonical_digest(spark, sf):
    return table(spark, sf, "events").select("event_id", T.digest(user_id=F.col("user_id"), props=F.col("props"), event_type=F.col("event_type")).alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'license')) AS hits FROM documents WHERE contains(lower(text), 'license')")
def phrase_counts(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").where(F.contains(low, F.lit("license"))).select("doc_id", F.size(F.regexp_extract_all(low, F.lit("license"), 0)).cast("long").alias("hits"))
