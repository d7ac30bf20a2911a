"""Queries of pages: kinds, continuation, documents, entities, labelled and structured values, languages, synthetic coordinates, text and delimited files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages, routing
from .registry import query, table

#: Page texts, one for every ninth part, and the title, kind and confidence that each must get.
PAGES = [
    ("BON DE COMMANDE\nNo 123456\nDésignation Quantité Prix unitaire Montant", "purchase_order", "purchase_order", 0.995), ("Facture\nTotal TTC 12,00", "invoice", "invoice", 0.9947), ("hello world", None, "generic_document", 0.45),
    ("Conditions générales d'achat\n1 Objet\n2 Prix\n3 Delai\n4 Litiges responsabilite resiliation", None, "legal_terms", 0.9949), ("Voir nos conditions generales\nDevis valable 30 jours", None, "quotation", 0.576), ("Commande N° 4500123456\nProduit", "purchase_order", "purchase_order", 0.9939),
    ("Contrat et agreement", None, "contract", 0.7362), ("Demande de PAGE PRIX\nx", "request_for_quotation", "request_for_quotation", 0.9921), (None, None, "generic_document", 0.45),
]
_SQL = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
_CASE = lambda i: "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {r[i] if i == 3 else _SQL(r[i])}" for k, r in enumerate(PAGES)) + " END"


def page_texts(spark, sf):
    text = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, r in enumerate(PAGES):
        text = text.when(F.col("p_partkey") % 9 == k, F.lit(r[0]))
    return table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 3).alias("doc_id"), (F.col("p_partkey") % 3 + 1).cast("int").alias("page"), text.alias("text"), "p_partkey")


_CLASSIFIED = f"SELECT p_partkey // 3 AS doc_id, CAST(p_partkey % 3 + 1 AS INT) AS page, {_CASE(1)} AS title, {_CASE(2)} AS kind, CAST({_CASE(3)} AS DOUBLE) AS confidence FROM part"


@query(_CLASSIFIED)
def page_classification(spark, sf):
    return routing.classify(page_texts(spark, sf)).select("doc_id", "page", "title", "kind", "confidence")


#: Pages of a document for every order: kinds, titles and tables by the numbers of its lines.
_PAGE = [
    "l_orderkey AS doc_id", "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) + CASE WHEN l_orderkey % 7 = 0 AND l_linenumber > 4 THEN 1 ELSE 0 END AS INT) AS page",
    "CASE l_suppkey % 5 WHEN 0 THEN 'purchase_order' WHEN 1 THEN 'legal_terms' WHEN 2 THEN 'generic_document' WHEN 3 THEN 'purchase_order' ELSE 'contract' END AS kind", "0.5 + l_discount AS confidence",
    "CASE WHEN l_suppkey % 5 = 3 THEN 'purchase_order' WHEN l_orderkey % 3 = 0 AND l_suppkey % 5 = 2 THEN 'invoice' ELSE NULL END AS title",
    "CASE l_partkey % 4 WHEN 0 THEN 'Commande n 12345678 page 2 sur 3' WHEN 1 THEN '[1234567890] 12,50 € [12345678901] 1 200,00 €' ELSE 'Commande n 12345678' END AS text", "l_partkey % 3 AS t",
]
_P = f"SELECT {', '.join(_PAGE)} FROM lineitem"


def document_pages(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_PAGE).withColumn("headers", F.when(F.col("t") == 0, F.array(F.lit("Ligne"), F.lit("Désignation"), F.lit("Qté"), F.lit("Prix unitaire"), F.lit("Montant"))))


@query(f"""WITH p AS ({_P}), m AS (SELECT doc_id, min(title) AS a, max(title) AS b FROM p GROUP BY 1)
SELECT doc_id, page, CASE WHEN a = b AND a <> 'purchase_order' AND title IS NULL AND kind = 'purchase_order' THEN a ELSE kind END AS kind, CASE WHEN a = b AND a <> 'purchase_order' AND title IS NULL AND kind = 'purchase_order' THEN least(confidence, 0.84) ELSE confidence END AS confidence FROM p JOIN m USING (doc_id)""")
def document_title_context(spark, sf):
    return routing.in_documents(document_pages(spark, sf)).select("doc_id", "page", "kind", "confidence")


@query(f"""WITH p AS (SELECT *, t = 0 OR text LIKE '[%' AS strong, text LIKE '%page%' AS weak FROM ({_P})), m AS (SELECT *, kind = 'purchase_order' OR strong OR weak AS may FROM p),
b AS (SELECT a.doc_id, a.page, max(o.page) AS origin FROM m a JOIN m o ON o.doc_id = a.doc_id AND o.page < a.page AND o.kind = 'purchase_order' GROUP BY ALL),
g AS (SELECT b.doc_id, b.page, count(x.page) = b.page - b.origin AS whole FROM b JOIN m x ON x.doc_id = b.doc_id AND x.page > b.origin AND x.page <= b.page AND x.may GROUP BY b.doc_id, b.page, b.origin),
r AS (SELECT m.*, kind <> 'purchase_order' AND may AND coalesce(whole, false) AS promoted FROM m LEFT JOIN g USING (doc_id, page))
SELECT doc_id, page, promoted, CASE WHEN promoted THEN 'purchase_order' ELSE kind END AS kind, CASE WHEN promoted THEN round(greatest(confidence, CASE WHEN strong THEN 0.84 ELSE 0.79 END), 4) ELSE confidence END AS confidence FROM r""")
def continuation_promotion(spark, sf):
    return routing.promote(document_pages(spark, sf)).select("doc_id", "page", "promoted", "kind", "confidence")


@query(f"""WITH p AS ({_P}), t AS (SELECT doc_id, kind, sum(confidence) AS total, avg(confidence) AS mean, avg(confidence) FILTER (title = kind) AS titled, min(page) AS first FROM p GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind <> 'purchase_order', round(total, 9) DESC, first) AS n, count(*) FILTER (kind <> 'generic_document') OVER (PARTITION BY doc_id) AS kinds, max(kind = 'legal_terms') OVER (PARTITION BY doc_id) AS legal FROM t)
SELECT doc_id, kind AS primary, CASE WHEN kind = 'purchase_order' AND legal THEN 'purchase_order_with_terms' WHEN kind = 'purchase_order' AND kinds > 1 THEN 'purchase_order_bundle' ELSE kind END AS detected, kinds > 1 AS is_composite, round(coalesce(titled, mean), 4) AS confidence FROM b WHERE n = 1""")
def document_kinds(spark, sf):
    return routing.documents(document_pages(spark, sf))


_TYPED = {"Amount due. Invoice number 4": "invoice", "RFQ 12": "request_for_quotation", "supplier material qty po no 4": "purchase_order", "nothing here": "x", "From: a To: b": "email", "Facture": "invoice"}


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'request_for_quotation' WHEN 2 THEN 'purchase_order' WHEN 3 THEN CASE p_partkey % 4 WHEN 1 THEN 'spreadsheet' ELSE 'generic_document' END WHEN 4 THEN 'email' ELSE 'invoice' END AS kind FROM part")
def document_types(spark, sf):
    text = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, t in enumerate(_TYPED):
        text = text.when(F.col("p_partkey") % 6 == i, F.lit(t))
    return table(spark, sf, "part").select("p_partkey", routing.document_type(text, F.when(F.col("p_partkey") % 4 == 1, "spreadsheet").otherwise("pdf")).alias("kind"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['fr', 'en'] WHEN 1 THEN ['de'] WHEN 2 THEN [] ELSE ['it', 'es'] END AS languages FROM part""")
def page_languages(spark, sf):
    texts = ["Commande fournisseur prix delivery price", "Bestellung Lieferant Menge", "prix", "ordine fornitore consegna pedido entrega"]
    text = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, t in enumerate(texts):
        text = text.when(F.col("p_partkey") % 4 == i, F.lit(t))
    return table(spark, sf, "part").select("p_partkey", routing.languages(text).alias("languages"))


_PRINTED = "concat('Mail ', lower(replace(c_name, '#', '.')), '@shop', CAST(c_nationkey AS STRING), '.fr or https://shop.example/', CAST(c_custkey AS STRING), ' on 2024-05-0', CAST(c_custkey % 9 + 1 AS STRING), ' for EUR ', CAST(c_custkey AS STRING), '.50 at 20% Tel 01 02 03 04 ', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), ' SIRET 01 02 03 04 05')"


@query(f"""WITH e AS (SELECT c_custkey, unnest([{{label: 'EMAIL', value: lower(replace(c_name, '#', '.')) || '@shop' || c_nationkey || '.fr', confidence: 0.99}}, {{label: 'URL', value: 'https://shop.example/' || c_custkey, confidence: 0.99}}, {{label: 'DATE', value: '2024-05-0' || (c_custkey % 9 + 1), confidence: 0.9}},
{{label: 'AMOUNT', value: 'EUR ' || c_custkey || '.50', confidence: 0.9}}, {{label: 'PERCENT', value: '20%', confidence: 0.95}}]) AS x FROM customer)
SELECT c_custkey AS doc_id, 0 AS ix, x.label, x.value, CAST(x.confidence AS DOUBLE) AS confidence FROM e""")
def entities(spark, sf):
    """The phone stands beside a registration, and so does the number after it: neither is one."""
    blocks = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("ix"), F.lit(1).alias("page"), F.expr(_PRINTED).alias("text"), F.lit("purchase_order").alias("page_kind"))
    return pages.entities(blocks)


@query("""SELECT s_suppkey AS doc_id, 1 AS ix, 'PHONE' AS label, '01 02 03 04 ' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS value, 0.75::DOUBLE AS confidence FROM supplier
UNION ALL SELECT s_suppkey, 2, 'AMOUNT', s_suppkey || ',50 €', 0.9::DOUBLE FROM supplier UNION ALL SELECT s_suppkey, 3, 'AMOUNT', '99,10', 0.9::DOUBLE FROM supplier""")
def entity_guards(spark, sf):
    """Of legal pages, clause numbers are no amounts; a repeated phone counts once a page."""
    k = F.col("s_suppkey").cast("string")
    phone = F.concat(F.lit("Tel 01 02 03 04 "), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"))
    texts = F.array(F.concat(phone, F.lit(" fin, "), phone), F.concat(F.lit("13.10 Prix "), k, F.lit(",50 €")), F.lit("montant 99,10"), F.lit("clause 12.10 et 44,20 jours"))
    blocks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.posexplode(texts).alias("ix", "text")).withColumns({"page": F.lit(1), "page_kind": F.lit("legal_terms"), "ix": F.col("ix") + 1})
    return pages.entities(blocks)


@query("""SELECT o_orderkey AS doc_id, x.label, x.value, CAST(x.confidence AS DOUBLE) AS confidence FROM (SELECT o_orderkey, unnest([{label: 'Order', value: 'PO-' || o_orderkey, confidence: 0.95}, {label: 'priority', value: o_orderpriority, confidence: 0.95}, {label: 'Customer', value: CAST(o_custkey AS VARCHAR), confidence: 0.9}]) AS x FROM orders)
UNION ALL SELECT o_orderkey, 'Status', o_orderstatus, 0.9::DOUBLE FROM orders WHERE o_orderkey % 2 = 0""")
def labelled_values(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("Order : PO-"), key, F.lit("\n  priority = "), F.col("o_orderpriority"), F.lit("\nno pair here\nORDER: PO-"), key)
    blocks = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("ix"), text.alias("text"))
    row = lambda r, *values: [F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), v.cast("string").alias("text")) for c, v in enumerate(values)]
    cells = F.array(*row(0, F.lit("Customer"), F.lit(None), F.col("o_custkey")), *row(1, F.lit("Status"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 1, F.lit("third"))), *row(2, F.lit("order"), F.concat(F.lit("PO-"), key)))
    return pages.key_values(blocks, o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("table"), F.explode(cells).alias("c")).select("doc_id", "table", "c.*"))


@query("""SELECT event_id, 'event.id' AS path, CAST(event_id AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'event.tags[0]', event_type FROM events UNION ALL SELECT event_id, 'event.tags[1].k', json_extract_string(props, '$.k') FROM events UNION ALL SELECT event_id, '[0][0]', 'x' FROM events WHERE false UNION ALL SELECT event_id, 'on', 'true' FROM events""")
def json_flatten(spark, sf):
    nested = F.concat(F.lit('{"event": {"id": '), F.col("event_id").cast("string"), F.lit(', "tags": ["'), F.col("event_type"), F.lit('", '), F.col("props"), F.lit(', null]}, "on": true, "none": null}'))
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") >= 0, nested).alias("tree"))
    return pages.json_tree(rows, "event_id", "tree")


@query(r"""WITH w AS (SELECT conv_id * 1000 + turn AS doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '[\s\x{a0}\x{202f}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations WHERE trim(text) <> ''),
u AS (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS place FROM w), x AS (SELECT *, greatest(8.0::DOUBLE, length(text) * 6.0::DOUBLE) AS wide FROM u)
SELECT doc_id, CAST(place AS INT) AS place, text, 10.0::DOUBLE + coalesce(sum(wide + 5) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM x""")
def synthetic_coordinates(spark, sf):
    blocks = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit(0).alias("ix"), "text")
    return pages.synthetic_words(blocks).select("doc_id", "place", "text", "x0")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row FROM documents)
SELECT doc_id, CAST(row AS INT) AS row, CASE WHEN starts_with(trim(line), '#') THEN 'heading' WHEN regexp_matches(trim(line), '^([-*+]|[0-9]+[.)]) ') THEN 'list_item' ELSE 'paragraph' END AS kind, sha256(trim(line)) AS line FROM l WHERE trim(line) <> ''""")
def text_blocks(spark, sf):
    """Lines of texts with their kind, without Python."""
    line = F.trim("line")
    kind = F.when(line.startswith("#"), "heading").when(line.rlike(r"^([-*+]|[0-9]+[.)]) "), "list_item").otherwise("paragraph")
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ix", "line")).where(line != "")
    return rows.select("doc_id", (F.col("ix") + 1).alias("row"), kind.alias("kind"), F.sha2(line, 256).alias("line"))


@query("""WITH m AS (SELECT conv_id, turn, string_split(text, chr(10))[1] AS subject, text FROM conversations WHERE trim(text) <> '' AND role = 'user')
SELECT CAST(conv_id AS VARCHAR) || '-' || turn || '.eml' AS path, 'key_value' AS kind, 'From: a' || conv_id || '@b.fr' AS text FROM m UNION ALL SELECT CAST(conv_id AS VARCHAR) || '-' || turn || '.eml', 'paragraph', 'Commande ' || conv_id FROM m
UNION ALL SELECT 'o' || o_orderkey || '.csv', 'cell', unnest(['order', 'status', CAST(o_orderkey AS VARCHAR), o_orderstatus]) FROM orders WHERE o_orderkey < 500 UNION ALL SELECT 'p' || p_partkey || '.xml', 'paragraph', unnest([p_name, p_brand]) FROM part
UNION ALL SELECT 'h' || s_suppkey || '.html', unnest(['heading', 'paragraph']), unnest([s_name, 'Solde ' || s_nationkey]) FROM supplier""")
def file_blocks(spark, sf):
    """Mails, delimited, XML and HTML files made of the tables' rows, read by their ending."""
    from ..sources import files

    c = table(spark, sf, "conversations").where("trim(text) <> '' AND role = 'user'")
    mail = c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".eml")).alias("path"), F.concat(F.lit("From: a"), F.col("conv_id").cast("string"), F.lit("@b.fr\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nCommande "), F.col("conv_id").cast("string"), F.lit("\r\n")).alias("t"))
    csv = table(spark, sf, "orders").where("o_orderkey < 500").select(F.concat(F.lit("o"), "o_orderkey", F.lit(".csv")).alias("path"), F.concat(F.lit("order;status\n"), "o_orderkey", F.lit(";"), "o_orderstatus", F.lit("\n")).alias("t"))
    xml = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(".xml")).alias("path"), F.concat(F.lit("<part><name> "), "p_name", F.lit("</name><x><brand>"), "p_brand", F.lit("</brand></x></part>")).alias("t"))
    html = table(spark, sf, "supplier").select(F.concat(F.lit("h"), "s_suppkey", F.lit(".html")).alias("path"), F.concat(F.lit("<h1>"), "s_name", F.lit("</h1><p>Solde <b>"), "s_nationkey", F.lit("</b></p><script>p</script>")).alias("t"))
    all_ = mail.unionByName(csv).unionByName(xml).unionByName(html).select("path", F.encode("t", "UTF-8").alias("content"))
    # the tables are small files, each of which would be one task's
    return files.read_files(all_.repartition("path")).where("part = 'block'").select("path", "kind", "text")
