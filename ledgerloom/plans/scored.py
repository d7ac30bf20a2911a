"""Queries of scoring: labels, values, boxes, documents and models against the truth, exact splits, class probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checksums
from ..operators import scoring as S
from .probes import probe
from .registry import query, table

_PAIR = ["CASE l_suppkey % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'TOTAL_NET' WHEN 2 THEN 'ORDER_NUMBER' WHEN 3 THEN 'CITY' ELSE 'IGNORED' END AS truth", "CASE WHEN l_partkey % 4 = 0 THEN 'O' WHEN l_partkey % 7 = 0 THEN 'GHOST' ELSE CASE l_suppkey % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'TOTAL_NET' WHEN 2 THEN 'ORDER_NUMBER' WHEN 3 THEN 'CITY' ELSE 'O' END END AS prediction"]
_SHARE = lambda a, b: f"round(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END, 9)"


@query(f"""WITH p AS (SELECT {', '.join(_PAIR)} FROM lineitem), q AS (SELECT * FROM p WHERE truth <> 'IGNORED'),
t AS (SELECT count(*) AS n, count(*) FILTER (truth = prediction) AS c, count(*) FILTER (truth <> 'O') AS i, count(*) FILTER (truth <> 'O' AND truth = prediction) AS h, count(*) FILTER (prediction <> 'O' AND truth <> prediction) AS fp FROM q),
l AS (SELECT truth AS label, count(*) AS s, count(*) FILTER (truth = prediction) AS h FROM q WHERE truth <> 'O' GROUP BY 1), r AS (SELECT prediction AS label, count(*) AS p FROM q WHERE prediction <> 'O' GROUP BY 1)
SELECT n AS support, i AS inside_support, {_SHARE('c', 'n')} AS token_accuracy, {_SHARE('h', 'i')} AS inside_accuracy, {_SHARE('h', 'h + fp')} AS precision, {_SHARE('h', 'i')} AS recall, {_SHARE('2.0 * h', 'h + fp + i')} AS f1,
round((SELECT avg(2.0::DOUBLE * h / (s + coalesce(p, 0))) FROM l LEFT JOIN r USING (label)), 9) AS macro_f1 FROM t""")
def label_metrics(spark, sf):
    return S.label_metrics(table(spark, sf, "lineitem").selectExpr(*_PAIR))


_RECORD = [
    "CASE c_nationkey % 4 WHEN 0 THEN 'ORDER_NUMBER' WHEN 1 THEN 'TOTAL_NET' WHEN 2 THEN 'CITY' ELSE NULL END AS label", "CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_name END AS truth",
    "CASE c_custkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN concat(c_name, 'x') WHEN 2 THEN 'nothing' ELSE replace(c_name, '#', ' ') END AS candidate", "CASE c_custkey % 3 WHEN 0 THEN c_name ELSE concat('Cust ', CAST(c_custkey AS STRING)) END AS baseline", "c_custkey % 7 <> 0 AS baseline_present",
]
_VALUES = f"""WITH r AS (SELECT {', '.join(_RECORD)} FROM customer), k AS (SELECT coalesce(label, 'UNKNOWN') AS label, baseline_present, regexp_replace(lower(truth), '[^a-z0-9]+', '', 'g') AS t, regexp_replace(lower(candidate), '[^a-z0-9]+', '', 'g') AS c, regexp_replace(lower(baseline), '[^a-z0-9]+', '', 'g') AS b FROM r),
s AS (SELECT label, t, baseline_present, CASE WHEN t = '' OR c = '' THEN (t = c)::INT ELSE 1.0 - levenshtein(t, c)::DOUBLE / greatest(length(t), length(c)) END AS cs, CASE WHEN NOT baseline_present THEN 0.0 WHEN t = '' OR b = '' THEN (t = b)::INT ELSE 1.0 - levenshtein(t, b)::DOUBLE / greatest(length(t), length(b)) END AS bs FROM k),
v AS (SELECT label, count(*) AS support, round(avg((t <> '' AND cs = 1)::INT), 9) AS candidate_exact, round(avg((cs >= 0.9)::INT), 9) AS candidate_soft, round(avg((t <> '' AND bs = 1)::INT), 9) AS baseline_exact, round(avg((bs >= 0.9)::INT), 9) AS baseline_soft, round(avg(baseline_present::INT), 9) AS baseline_coverage FROM s GROUP BY ROLLUP (label))"""


@query(_VALUES + " SELECT * FROM v")
def value_metrics(spark, sf):
    return S.value_metrics(table(spark, sf, "customer").selectExpr(*_RECORD))


@query(_VALUES + """, c AS (SELECT coalesce(list_sort(list(label)), []) AS regressions FROM v WHERE label IN ('ORDER_NUMBER', 'TOTAL_NET') AND support >= 2 AND candidate_exact - baseline_exact < -0.02), a AS (SELECT * FROM v WHERE label IS NULL)
SELECT CASE WHEN len(regressions) > 0 THEN 'REGRESSION' WHEN candidate_exact > baseline_exact THEN 'CANDIDATE_BETTER' WHEN candidate_exact < baseline_exact THEN 'REGRESSION' ELSE 'REVIEW_REQUIRED' END AS status, regressions, false AS automatic_promotion FROM a, c""")
def benchmark_decision(spark, sf):
    return S.decision(value_metrics(spark, sf), F.lit(40), F.lit(0.8))


#: Boxes of an order's lines, drawn twice with a shift; kinds by supplier.
_TRUE = ["l_orderkey AS doc_id", "CAST(l_suppkey % 3 AS INT) AS kind", "CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS tix", "CAST(l_linenumber * 20 AS DOUBLE) AS t0", "CAST(l_partkey % 5 * 10 AS DOUBLE) AS t1", "CAST(l_linenumber * 20 + 30 AS DOUBLE) AS t2", "CAST(l_partkey % 5 * 10 + 20 AS DOUBLE) AS t3", "l_partkey AS k"]
_PREDICTED = ["doc_id", "kind", "tix AS pix", "t0 + k % 4 AS p0", "t1 + k % 3 AS p1", "t2 + k % 4 AS p2", "t3 + k % 3 AS p3", "k"]


def boxes_of(spark, sf):
    truth = table(spark, sf, "lineitem").selectExpr(*_TRUE)
    return truth.selectExpr(*_PREDICTED).where("k % 11 <> 0").drop("k"), truth.drop("k")


@query()
def spatial_matches(spark, sf):
    return S.greedy_matches(*boxes_of(spark, sf), ["doc_id", "kind"]).select("doc_id", "kind", "pix", "tix", F.round("iou", 9).alias("iou"))


@query()
def spatial_scores(spark, sf):
    return S.spatial_metrics(*boxes_of(spark, sf), ["doc_id", "kind"], "kind")


_FIELD_T = "unnest([{path: 'number', value: 'PO-' || o_orderkey}, {path: 'order_date', value: strftime(o_orderdate, '%d/%m/%Y')}, {path: 'totals.total_net', value: o_custkey || ',50'}, {path: 'buyer.name', value: 'Customer ' || o_custkey || ' SA'}, {path: 'lines[0].reference', value: 'R ' || o_custkey}, {path: 'lines[1].reference', value: CASE WHEN o_orderkey % 2 = 0 THEN 'S' || o_orderkey END}])"
_FIELD_P = "unnest([{path: 'number', value: CASE o_orderkey % 3 WHEN 0 THEN 'po-' || o_orderkey WHEN 1 THEN 'X' ELSE NULL END}, {path: 'order_date', value: CASE o_orderkey % 2 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%m.%Y') END}, {path: 'totals.total_net', value: o_custkey || '.5'}, {path: 'buyer.name', value: 'customer ' || o_custkey || ' sarl'}, {path: 'lines[0].reference', value: 'r' || o_custkey}, {path: 'extra', value: 'x'}])"
_DETAILS = f"""WITH t AS (SELECT o_orderkey AS doc_id, x.path, x.value FROM (SELECT o_orderkey, {_FIELD_T} AS x FROM orders) WHERE x.value IS NOT NULL), p AS (SELECT o_orderkey AS doc_id, x.path, x.value FROM (SELECT o_orderkey, {_FIELD_P} AS x FROM orders) WHERE x.value IS NOT NULL),
d AS (SELECT doc_id, path, t.value AS expected, p.value AS actual, CASE WHEN t.value IS NOT NULL THEN CASE path WHEN 'number' THEN doc_id % 3 = 0 WHEN 'order_date' THEN doc_id % 2 = 0 WHEN 'totals.total_net' THEN true WHEN 'buyer.name' THEN false WHEN 'lines[0].reference' THEN true ELSE false END END AS match FROM t FULL JOIN p USING (doc_id, path)),
f AS (SELECT *, CASE WHEN expected IS NOT NULL THEN CASE WHEN actual IS NULL THEN 0.0 WHEN path = 'order_date' THEN match::INT::DOUBLE WHEN path = 'buyer.name' THEN 2.0 / 3 WHEN path = 'number' THEN match::INT::DOUBLE WHEN path = 'totals.total_net' THEN 0.5 WHEN path = 'lines[0].reference' THEN 0.0 ELSE 0.0 END END AS token_f1 FROM d)"""


def field_tables(spark, sf):
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    day = lambda form: F.date_format("o_orderdate", form)
    pair = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"))
    truth = F.array(pair("number", F.concat(F.lit("PO-"), key)), pair("order_date", day("dd/MM/yyyy")), pair("totals.total_net", F.concat(cust, F.lit(",50"))), pair("buyer.name", F.concat(F.lit("Customer "), cust, F.lit(" SA"))), pair("lines[0].reference", F.concat(F.lit("R "), cust)), pair("lines[1].reference", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("S"), key))))
    found = F.array(pair("number", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("po-"), key)).when(F.col("o_orderkey") % 3 == 1, "X")), pair("order_date", F.when(F.col("o_orderkey") % 2 == 0, day("yyyy-MM-dd")).otherwise(day("MM.yyyy"))), pair("totals.total_net", F.concat(cust, F.lit(".5"))), pair("buyer.name", F.concat(F.lit("customer "), cust, F.lit(" sarl"))), pair("lines[0].reference", F.concat(F.lit("r"), cust)), pair("extra", F.lit("x")))
    flat = lambda c: o.select(F.col("o_orderkey").alias("doc_id"), F.explode(c).alias("f")).select("doc_id", "f.*")
    return flat(truth), flat(found)


@query(_DETAILS + " SELECT doc_id, path, match, round(token_f1, 6) AS token_f1 FROM f")
def field_details(spark, sf):
    return S.field_details(*field_tables(spark, sf)).select("doc_id", "path", "match", F.round("token_f1", 6).alias("token_f1"))


_METRICS = _DETAILS + """, m AS (SELECT doc_id, count(expected) AS truth_fields, count(actual) AS predicted_fields, count(*) FILTER (match) AS exact, round(avg(token_f1), 9) AS field_token_f1, count(*) FILTER (expected IS NOT NULL AND actual IS NULL) AS miss, count(*) FILTER (expected IS NULL) AS invented FROM f GROUP BY 1),
e AS (SELECT doc_id, truth_fields, predicted_fields, exact, round(exact / truth_fields, 9) AS field_exact_match, field_token_f1, round(miss / truth_fields, 9) AS missing_field_rate, round(invented / predicted_fields, 9) AS hallucination_rate, CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS line_item_reference_recall FROM m)"""


@query(_METRICS + " SELECT * FROM e")
def extraction_metrics(spark, sf):
    return S.extraction_metrics(S.field_details(*field_tables(spark, sf)))


def _model_rows(spark, sf):
    """Two models: the metrics as they are, and the same with every fourth document better and every ninth failed."""
    base = extraction_metrics(spark, sf).select("doc_id", *(m for m, _ in S.ORDER))
    a = base.withColumns({"model": F.lit("a"), "error": F.lit(None).cast("string")})
    b = base.where("doc_id % 50 <> 0").withColumns({"model": F.lit("b"), "error": F.when(F.col("doc_id") % 9 == 0, "timeout"), "field_exact_match": F.when(F.col("doc_id") % 4 == 0, 1.0).otherwise(F.col("field_exact_match")), "field_token_f1": F.when(F.col("doc_id") % 4 == 1, 0.0).otherwise(F.col("field_token_f1"))})
    return a, b


_MODELS = _METRICS + """, ma AS (SELECT *, 'a' AS model, CAST(NULL AS VARCHAR) AS error FROM e), mb AS (SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN 1.0::DOUBLE ELSE field_exact_match END AS field_exact_match, CASE WHEN doc_id % 4 = 1 THEN 0.0::DOUBLE ELSE field_token_f1 END AS field_token_f1), 'b' AS model, CASE WHEN doc_id % 9 = 0 THEN 'timeout' END AS error FROM e WHERE doc_id % 50 <> 0)"""


@query(_MODELS + """ SELECT model, count(*) AS documents, count(*) FILTER (error IS NULL) AS completed, count(error) AS errors, 1.0::DOUBLE AS json_valid_rate, round(avg(field_exact_match) FILTER (error IS NULL), 9) AS field_exact_match, round(avg(field_token_f1) FILTER (error IS NULL), 9) AS field_token_f1, round(avg(missing_field_rate) FILTER (error IS NULL), 9) AS missing_field_rate,
round(avg(hallucination_rate) FILTER (error IS NULL), 9) AS hallucination_rate, round(avg(line_item_reference_recall) FILTER (error IS NULL), 9) AS line_item_reference_recall, round(avg((doc_id % 10)::DOUBLE) FILTER (error IS NULL), 9) AS latency, CAST(max(doc_id % 100) FILTER (error IS NULL) AS DOUBLE) AS rss_max FROM (SELECT * FROM ma UNION ALL SELECT * FROM mb) GROUP BY model""")
def model_summaries(spark, sf):
    a, b = _model_rows(spark, sf)
    rows = a.unionByName(b).withColumns({"json_valid": F.lit(None).cast("boolean"), "latency": (F.col("doc_id") % 10).cast("double"), "rss": (F.col("doc_id") % 100).cast("double")})
    return S.model_summary(rows)


_HEADS = _MODELS + """, h AS (SELECT 'b' AS model, ma.doc_id, CASE WHEN mb.doc_id IS NULL THEN 'MISSING_DOCUMENT_RESULT' WHEN mb.error IS NOT NULL THEN 'ERROR' ELSE 'COMPARABLE' END AS status, CASE WHEN mb.field_exact_match > ma.field_exact_match + 1e-12 THEN 'CANDIDATE' WHEN mb.field_token_f1 < ma.field_token_f1 - 1e-12 THEN 'BASELINE' ELSE 'TIE' END AS w FROM ma LEFT JOIN mb USING (doc_id)),
hh AS (SELECT model, doc_id, status, CASE WHEN status = 'COMPARABLE' THEN w ELSE 'UNAVAILABLE' END AS winner FROM h)"""


@query(_HEADS + " SELECT * FROM hh")
def model_head_to_head(spark, sf):
    a, b = _model_rows(spark, sf)
    return S.head_to_head(a, b)


@query(_HEADS + " SELECT model, count(*) FILTER (status = 'COMPARABLE') AS compared, count(*) FILTER (winner = 'CANDIDATE') AS won, count(*) FILTER (winner = 'BASELINE') AS lost, count(*) FILTER (winner = 'TIE') AS tied FROM hh GROUP BY model")
def model_head_to_head_summary(spark, sf):
    return S.head_to_head_summary(model_head_to_head(spark, sf))


@query(_DETAILS + """, c AS (SELECT doc_id, path, coalesce(match, false) AS b, coalesce(token_f1, 0) AS bf, CASE WHEN path = 'buyer.name' THEN true WHEN path = 'number' THEN false ELSE coalesce(match, false) END AS c, CASE WHEN path = 'extra' THEN 0.0 ELSE 0.25 END AS cf FROM f WHERE path <> 'extra' OR doc_id % 2 = 0)
SELECT 'm' AS model, doc_id, path, CASE WHEN c AND b THEN 'BOTH_CORRECT' WHEN c THEN 'CANDIDATE_WIN' WHEN b THEN 'BASELINE_WIN' ELSE 'BOTH_WRONG' END AS outcome, round(cf - bf, 6) AS delta FROM c""")
def field_comparison(spark, sf):
    d = S.field_details(*field_tables(spark, sf)).where("path <> 'extra' OR doc_id % 2 = 0")
    other = d.withColumns({"model": F.lit("m"), "match": F.when(F.col("path") == "buyer.name", True).when(F.col("path") == "number", False).otherwise(F.col("match")), "token_f1": F.when(F.col("path") == "extra", 0.0).otherwise(0.25)})
    return S.field_comparison(d, other).withColumn("delta", F.round("delta", 6))


probe("address_verdicts", {"verdict": lambda x: S.address_verdict(F.lit("12 rue de la Paix 69000 Lyon"), x)}, [
    ("12 rue de la paix, 69000 LYON", "CORRECT"), ("rue de la Paix 69000 Lyon", "CORRECT"), ("12 rue de la Paix 75002 Paris", "INCORRECT"), ("rue Paix Lyon X", "INCORRECT"), ("rue de Paix Lyon", "PARTIAL"), ("", "INCORRECT"),
])

probe("any_dates", {"date": checksums.any_date}, [
    ("2024-05-07", "2024-05-07"), ("7/5/2024", "2024-05-07"), ("07.05.24", "2024-05-07"), ("07-05-99", "1999-05-07"), ("7/5.2024", None), ("31/02/2024", None), ("2024/05/07", None), ("", None), ("le 7", None), (" 07/05/68 ", "2068-05-07"),
], {"date": "VARCHAR"})

probe("registration_values", {"siren": lambda x: checksums.registration_identifiers(x)["siren"], "siret": lambda x: checksums.registration_identifiers(x)["siret"], "same_vat": lambda x: checksums.vat_equivalent(x, F.lit("FR40303265045"))}, [
    ("732 829 320", "732829320", None, False), ("73282932000074", "732829320", "73282932000074", False), ("123456789", None, None, False), ("FR 4O 3O3265O45", None, None, True), ("FR40303265045", None, None, True), ("", None, None, False),
], {"siret": "VARCHAR"})

_DATED = ["o_orderkey AS doc_id", "CASE o_orderkey % 4 WHEN 0 THEN array('a', 'b') WHEN 1 THEN array('a') ELSE cast(array() as array<string>) END AS source", "CASE o_custkey % 4 WHEN 0 THEN array('b', 'a') WHEN 1 THEN array('a') WHEN 2 THEN array('c') ELSE cast(array() as array<string>) END AS model", "o_orderkey % 4 = 2 AS labelled"]


@query("""WITH d AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS s, o_custkey % 4 AS m FROM orders)
SELECT doc_id, CASE WHEN (s = 0 AND m = 0) OR (s = 1 AND m = 1) THEN 'SOURCE_MATCH' WHEN (s = 0 AND m = 1) OR (s = 1 AND m = 0) THEN 'PARTIAL_MATCH' WHEN s < 2 AND m = 3 THEN 'MODEL_MISSING' WHEN s < 2 THEN 'DATE_MISMATCH' WHEN s = 2 AND m = 3 THEN 'LABEL_WITHOUT_DATE_REVIEW' WHEN m < 3 THEN 'MODEL_ONLY_REVIEW' ELSE 'NO_DELIVERY_DATE_SIGNAL' END AS verdict FROM d""")
def delivery_date_audit(spark, sf):
    return table(spark, sf, "orders").selectExpr(*_DATED).select("doc_id", S.date_audit(F.col("source"), F.col("model"), F.col("labelled")).alias("verdict"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('v2:' || doc_id), doc_id) - 1 AS n, count(*) OVER () AS total FROM documents), s AS (SELECT *, greatest(1, CAST(round_even(total * 0.15::DOUBLE, 0) AS BIGINT)) AS held FROM r)
SELECT doc_id, CASE WHEN n < held THEN 'test' WHEN n < 2 * held THEN 'validation' ELSE 'train' END AS split FROM s""")
def ranked_splits(spark, sf):
    return S.ranked_splits(table(spark, sf, "documents"), "v2")


@query("SELECT CAST(label AS VARCHAR) AS label, count(*) AS tokens, count(DISTINCT vec_id % 7) AS documents FROM embeddings GROUP BY 1")
def label_support(spark, sf):
    return S.label_support(table(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("doc_id"), F.col("label").cast("string").alias("label")))


@query("""WITH x AS (SELECT event_id, [1 + event_id % 5, 2 + event_id % 3, 1] AS w FROM events), p AS (SELECT event_id, list_transform(w, lambda v: v::DOUBLE / list_sum(w)) AS p FROM x), t AS (SELECT event_id, p, list_transform(p, lambda v: exp(ln(v) / 7)) AS q FROM p)
SELECT event_id, round(list_max(q) / list_sum(q), 9) AS tempered, round(0.62 * (1 - list_max(p)) + 0.38 * -list_sum(list_transform(p, lambda v: v * ln(v))) / ln(3), 9) AS ood, CASE WHEN p[1] >= p[2] THEN 'a' ELSE 'b' END AS best FROM t""")
def class_probabilities(spark, sf):
    k = F.col("event_id")
    w = F.array((1 + k % 5).cast("double"), (2 + k % 3).cast("double"), F.lit(1.0))
    p = table(spark, sf, "events").select("event_id", F.transform(w, lambda v: v / F.aggregate(w, F.lit(0.0), lambda a, x: a + x)).alias("p"))
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return p.select("event_id", F.round(F.array_max(S.temperature(F.col("p"), 7.0)), 9).alias("tempered"), F.round(S.out_of_distribution(F.col("p")), 9).alias("ood"), S.top_classes(names, F.col("p"), 2)[0]["class"].alias("best"))


@query("""WITH f AS (SELECT c_mktsegment AS family, count(*) AS total FROM customer GROUP BY 1), d AS (SELECT DISTINCT c_nationkey % 4 AS decision FROM customer), n AS (SELECT c_mktsegment AS family, c_nationkey % 4 AS decision, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 OR c_nationkey % 4 <> 1 GROUP BY ALL),
t AS (SELECT family, sum(n) AS total FROM n GROUP BY 1) SELECT family, decision, (coalesce(n, 0) + 1) / (t.total + (SELECT count(DISTINCT decision) FROM n)) AS prior FROM t CROSS JOIN (SELECT DISTINCT decision FROM n) LEFT JOIN n USING (family, decision)""")
def family_priors(spark, sf):
    rows = table(spark, sf, "customer").where("c_custkey % 2 = 0 OR c_nationkey % 4 <> 1").select(F.col("c_mktsegment").alias("family"), (F.col("c_nationkey") % 4).alias("decision"))
    return S.family_prior(rows)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM v)
SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 9) AS length, CASE WHEN u[1] >= u[2] AND u[1] >= u[3] THEN 'first' WHEN u[2] >= u[3] THEN 'second' ELSE 'third' END AS zone FROM u""")
def embedding_zones(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", S.unit(F.slice("embedding", 1, 3)).alias("u"))
    axes = [("first", [1.0, 0.0, 0.0]), ("second", [0.0, 1.0, 0.0]), ("third", [0.0, 0.0, 1.0])]
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 9).alias("length"), S.nearest_class(F.col("u"), axes).alias("zone"))
