"""All queries of the library over the shared test tables, with their SQL.

The order tables stand in for extracted orders: ``lineitem`` for lines, ``orders`` for printed totals, ``part`` for the product list,
``customer`` and ``supplier`` for parties, ``conversations`` for revisions, ``events`` for logs and queues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums
from ..functions import text as T
from ..operators import evaluation, history, pages, parties, references, support, validation
from ..sources import readers
from ..streaming import feedback
from . import addressed, annotated, judged, laid, ordered, paged, readings, routed, scalars, scored, stored, tabled  # noqa: F401  (enter their queries)
from .registry import ORACLE_SQL, QUERIES, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]

def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as order lines; the unit price is the extended price without its discount."""
    item = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    return item.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ix"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("material"), F.col("l_quantity").alias("quantity"), price.alias("unit_price"), F.col("l_extendedprice").alias("line_total"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("total"))


_LINES = "SELECT l_orderkey AS doc_id, l_linenumber AS ix, l_partkey AS material, l_quantity AS quantity, l_extendedprice * (1 - l_discount) / l_quantity AS unit_price, l_extendedprice AS line_total FROM lineitem"
_DOCS = "SELECT o_orderkey AS doc_id, o_totalprice AS total FROM orders"


def _close(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= greatest(0.03, 0.005 * greatest(abs({a}), abs({b}), 1))"


_CHECKED = f"SELECT *, CASE WHEN quantity IS NOT NULL AND unit_price IS NOT NULL AND line_total IS NOT NULL THEN CASE WHEN {_close('quantity * unit_price', 'line_total')} THEN 'VALID' ELSE 'INVALID' END END AS status FROM ({_LINES})"


@query(f"SELECT doc_id, ix, quantity, unit_price, line_total, status FROM ({_CHECKED})")
def line_arithmetic_check(spark, sf):
    return validation.check_lines(lines(spark, sf)).select("doc_id", "ix", "quantity", "unit_price", "line_total", "status")


@query(f"""WITH s AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(line_total AS DECIMAL(18,2))) AS DOUBLE) AS product_sum FROM ({_LINES}) GROUP BY doc_id)
SELECT s.doc_id, n_lines, product_sum, total, CASE WHEN total IS NULL THEN 'computed_only' WHEN {_close('product_sum', 'total')} THEN 'match' ELSE 'mismatch' END AS line_sum_status FROM s JOIN ({_DOCS}) USING (doc_id)""")
def order_line_sum_reconciliation(spark, sf):
    return validation.line_sums(lines(spark, sf), documents(spark, sf))


@query(f"""WITH s AS (SELECT doc_id, count(*) AS n_lines, count(status) AS checked, count(*) FILTER (status = 'VALID') AS valid, CAST(sum(CAST(line_total AS DECIMAL(18,2))) AS DOUBLE) AS product_sum FROM ({_CHECKED}) GROUP BY doc_id)
SELECT doc_id, n_lines, checked, valid, valid / greatest(1, checked) AS valid_ratio, product_sum,
CASE WHEN NOT ({_close('product_sum', 'total')}) THEN 'FAIL' WHEN checked > valid THEN 'WARNING' ELSE 'PASS' END AS status FROM s JOIN ({_DOCS}) USING (doc_id)""")
def order_validation_status(spark, sf):
    return validation.validate_orders(lines(spark, sf), documents(spark, sf))


@query(f"SELECT doc_id, count(*) AS duplicate_signatures FROM (SELECT doc_id, material, quantity FROM ({_LINES}) GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id")
def duplicate_line_signatures(spark, sf):
    return validation.duplicate_signatures(lines(spark, sf), ["material", "quantity"])


@query("""WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS a, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM lineitem)
SELECT doc_id, count(*) AS n_numbers, count(*) FILTER (b <= a) = 0 AS increasing FROM x GROUP BY doc_id HAVING count(*) > 1""")
def line_number_sequence(spark, sf):
    return validation.number_sequence(lines(spark, sf))


@query(f"""SELECT doc_id, 'LINE_ARITHMETIC' AS code, 'ERROR' AS severity, 'lines[' || ix || ']' AS path FROM ({_LINES}) WHERE abs(quantity * unit_price - line_total) > greatest(0.03, abs(quantity) * 0.005 + 0.005)
UNION ALL SELECT doc_id, 'QUANTITY_MISSING', 'WARN', 'lines[' || ix || ']' FROM ({_LINES}) WHERE quantity IS NULL
UNION ALL SELECT doc_id, 'PRICE_MISSING', 'WARN', 'lines[' || ix || ']' FROM ({_LINES}) WHERE unit_price IS NULL""")
def auditor_line_issues(spark, sf):
    return validation.audit_lines(lines(spark, sf).withColumns({"net_unit_price": F.lit(None).cast("double"), "price_unit": F.lit(None).cast("double")}))


@query(f"""SELECT doc_id, ['LINE_ARITHMETIC'] AS reasons, count(DISTINCT ix) AS n_issues, 'HUMAN_REVIEW' AS decision FROM ({_LINES})
WHERE abs(quantity * unit_price - line_total) > greatest(0.03, abs(quantity) * 0.005 + 0.005) GROUP BY doc_id""")
def extraction_gate(spark, sf):
    return validation.gate(auditor_line_issues(spark, sf))


@query("SELECT l_orderkey AS doc_id, avg(CASE WHEN l_quantity IS NULL THEN 0.0 ELSE 1.0 END) AS quantity_ratio, avg(CASE WHEN nullif(l_tax, 0) IS NULL THEN 0.0 ELSE 1.0 END) AS tax_ratio FROM lineitem GROUP BY 1")
def line_completeness_ratios(spark, sf):
    item = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("quantity"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return validation.completeness(item, ["quantity", "tax"])


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice) = 1")
def line_dedupe_keep_first(spark, sf):
    item = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return validation.keep_first(item, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"]).drop("l_shipdate", "l_extendedprice")


@query(r"SELECT l_orderkey AS doc_id, l_linenumber AS ix, CASE WHEN regexp_matches(lower(p_name), '\b(ring|bolt)\b') THEN 'charge' ELSE 'product' END AS kind FROM lineitem JOIN part ON p_partkey = l_partkey")
def charge_separation(spark, sf):
    named = lines(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("material"), F.col("p_name").alias("description")), "material")
    return validation.separate_charges(named, ["ring", "bolt"]).select("doc_id", "ix", "kind")


def _refs(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.col("p_brand"), F.lit("-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("ref"))


_SHAPES = """WITH k AS (SELECT DISTINCT regexp_replace(upper(p_brand || '-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')), '[^A-Z0-9]', '', 'g') AS key FROM part),
sh AS (SELECT key, CAST(length(key) AS VARCHAR) AS length, CASE WHEN regexp_matches(key, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches(key, '^[A-Z]+$') THEN 'alpha' ELSE 'mixed' END AS nature,
 array_to_string(list_transform(regexp_extract_all(key, '[A-Z]+|[0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN 'D' ELSE 'A' END || length(r)), '-') AS signature FROM k WHERE key <> ''),
long AS (SELECT key, unnest([{kind: 'length', value: length, w: 0.14::DOUBLE, s: 200}, {kind: 'nature', value: nature, w: 0.06::DOUBLE, s: 200}, {kind: 'length_nature', value: length || ':' || nature, w: 0.12::DOUBLE, s: 150}, {kind: 'signature', value: signature, w: 0.18::DOUBLE, s: 100},
 {kind: 'p1', value: key[1:1] || '@' || length, w: 0.05::DOUBLE, s: 150}, {kind: 'p2', value: key[1:2] || '@' || length, w: 0.18::DOUBLE, s: 100}, {kind: 'p3', value: key[1:3] || '@' || length, w: 0.19::DOUBLE, s: 30}], recursive := true) FROM sh),
c AS (SELECT kind, value, count(*) AS n FROM long GROUP BY ALL HAVING count(*) >= 2 OR kind NOT IN ('p1', 'p2', 'p3'))"""


@query(_SHAPES + " SELECT kind, value, n FROM c")
def reference_profile_counts(spark, sf):
    return references.profile(_refs(spark, sf))


@query(_SHAPES + """ SELECT key, round(CASE WHEN ok THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + t, 6) AS score, ok AND round(CASE WHEN ok THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + t, 6) >= 0.74 AS supported
FROM (SELECT key, sum(w * least(1.0::DOUBLE, ln(1 + coalesce(n, 0)) / ln(1 + s))) AS t, regexp_matches(key, '[0-9]') AND length(key) BETWEEN 4 AND 30 AND (NOT regexp_matches(key, '^[0-9]+$') OR length(key) >= 7) AS ok FROM long LEFT JOIN c USING (kind, value) GROUP BY key)""")
def reference_shape_score(spark, sf):
    refs = _refs(spark, sf)
    return references.score(refs, references.profile(refs))


@query(_SHAPES + " SELECT key, length, nature, signature FROM sh")
def structural_shapes(spark, sf):
    return references.shapes(_refs(spark, sf)).select("key", "length", "nature", "signature")


@query("SELECT n_name AS nation, arg_min(c_mktsegment, c_custkey) AS c_mktsegment, arg_min(nullif(c_acctbal, 0), c_custkey) FILTER (c_acctbal <> 0) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def party_first_non_null(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("nation"), "c_custkey", "c_mktsegment", F.nullif("c_acctbal", F.lit(0.0)).alias("balance"))
    return parties.first_non_null(rows, ["nation"], "c_custkey", ["c_mktsegment", "balance"])


@query("""SELECT fingerprint, list_sort(list(DISTINCT role)) AS roles, count(*) AS n FROM (SELECT sha256(lower(n_name) || '|' || r_name) AS fingerprint, role FROM
(SELECT c_nationkey AS k, 'bill_to' AS role FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey) GROUP BY 1 HAVING count(DISTINCT role) > 1""")
def shared_address_roles(spark, sf):
    both = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("bill_to").alias("role")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("role")))
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return parties.shared_roles(both.join(places, F.col("n_nationkey") == F.col("k")).select("role", F.sha2(F.concat(F.lower("n_name"), F.lit("|"), "r_name"), 256).alias("fingerprint")))


def _keyed(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), parties.address_key(F.lpad((F.col("c_custkey") % 300).cast("string"), 4, "0"), F.col("c_nationkey").cast("string")).alias("key"))
    s = table(spark, sf, "supplier").select(parties.address_key(F.lpad((F.col("s_suppkey") % 300).cast("string"), 4, "0"), F.col("s_nationkey").cast("string")).alias("key"))
    return c, s


_KEYED = "(SELECT lpad(CAST(s_suppkey % 300 AS VARCHAR), 4, '0') || '|' || s_nationkey FROM supplier)"


@query(f"SELECT c_custkey AS id FROM customer WHERE lpad(CAST(c_custkey % 300 AS VARCHAR), 4, '0') || '|' || c_nationkey IN {_KEYED}")
def address_key_semi_join(spark, sf):
    return parties.matches(*_keyed(spark, sf), exact=True).select("id")


@query(f"SELECT c_custkey AS id FROM customer WHERE lpad(CAST(c_custkey % 300 AS VARCHAR), 4, '0') || '|' || c_nationkey NOT IN {_KEYED}")
def address_key_anti_join(spark, sf):
    return parties.matches(*_keyed(spark, sf), exact=False).select("id")


@query(f"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\\x00-\\x7F]+', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS folded_sha256 FROM documents")
def text_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded_sha256"))


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS page, role AS kind, CASE WHEN role <> lag(role) OVER w OR turn - lag(turn) OVER w > 1 OR lag(role) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS run FROM c)
SELECT doc_id, run, kind, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM r GROUP BY doc_id, run, kind""")
def continuation_islands(spark, sf):
    return pages.continuation(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("role").alias("kind")))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_content_dedup(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.3 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256('v1:' || doc_id), 1, 8))::BIGINT / 4294967296 AS u FROM documents)")
def hash_split(spark, sf):
    return evaluation.hash_split(table(spark, sf, "documents"))


@query("""WITH o AS (SELECT source, sha256(text) AS d, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2)
SELECT source, doc_id, CAST(rank AS INT) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rank FROM o) WHERE rank <= 5""")
def stratified_sample(spark, sf):
    return evaluation.stratified(table(spark, sf, "documents"), "source", 5)


@query()
def html_blocks(spark, sf):
    return readers.html_blocks(table(spark, sf, "pages"))


@query()
def html_tables(spark, sf):
    return readers.html_tables(table(spark, sf, "pages"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_revision(spark, sf):
    return history.latest_revision(table(spark, sf, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, min(turn) AS first, max(turn) AS last, count(DISTINCT turn) AS n, min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AS contiguous FROM conversations GROUP BY 1")
def revision_gap_check(spark, sf):
    return history.revision_gaps(table(spark, sf, "conversations"), "conv_id", "turn")


@query("SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1, 2")
def audit_first_events(spark, sf):
    return history.first_seen(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def status_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT event_type, event_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events) WHERE place <= 10")
def fifo_claim(spark, sf):
    return history.claim(table(spark, sf, "events"), "event_type", 10, ["ts", "event_id"]).select("event_type", "event_id", "place")


@query("SELECT event_id, CASE WHEN epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts)) > 86400 THEN 'queued' ELSE 'running' END AS state FROM events")
def stale_recovery(spark, sf):
    return history.stale(table(spark, sf, "events"), "2024-01-15 00:00:00", 24 * 60).select("event_id", "state")


@query("SELECT user_id, count(*) AS n, count(DISTINCT md5(event_type)) AS digests, CASE WHEN count(DISTINCT event_type) > 1 THEN 'REJECTED' WHEN count(*) > 1 THEN 'DUPLICATE_IGNORED' ELSE 'ACCEPTED' END AS verdict FROM events GROUP BY 1")
def feedback_idempotent_dedup(spark, sf):
    return history.conflicts(table(spark, sf, "events").withColumn("digest", F.md5("event_type")), "user_id", "digest")


def _pairs(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(F.concat(F.lit("q"), "quality").alias("truth"), F.when(F.col("n_chars") > 600, "q1").otherwise("q0").alias("prediction"))


_REPORT = """WITH p AS (SELECT 'q' || quality AS truth, CASE WHEN n_chars > 600 THEN 'q1' ELSE 'q0' END AS prediction FROM documents JOIN labels USING (doc_id)),
x AS (SELECT truth AS label, 1 AS t, 0 AS p, (truth = prediction)::INT AS hit FROM p UNION ALL SELECT prediction, 0, 1, 0 FROM p),
s AS (SELECT label, CAST(sum(t) AS BIGINT) AS support, sum(p) AS predicted, sum(hit) AS hits FROM x GROUP BY 1),
r AS (SELECT label, support, hits / predicted AS precision, hits / support AS recall, 2.0::DOUBLE * hits / (predicted + support) AS f1 FROM s)"""


@query(_REPORT + " SELECT label, support, precision, recall, f1 FROM r")
def classification_report(spark, sf):
    return evaluation.classification(_pairs(spark, sf))


@query(_REPORT + " SELECT round(avg(f1), 9) AS macro_f1, count(*) AS labels FROM r WHERE support > 0")
def macro_f1(spark, sf):
    return evaluation.macro(evaluation.classification(_pairs(spark, sf)))


@query("""WITH a AS (SELECT item_id AS id, lower(text) AS r FROM benchmark), p AS (SELECT item_id - 1 AS id, lower(text) AS p FROM benchmark),
j AS (SELECT a.id, p.p, a.r FROM a JOIN p USING (id)),
wp AS (SELECT id, unnest(string_split(trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')), ' ')) AS w, 1 AS p, 0 AS r FROM j UNION ALL SELECT id, unnest(string_split(trim(regexp_replace(r, '[^a-z0-9]+', ' ', 'g')), ' ')), 0, 1 FROM j),
g AS (SELECT id, w, sum(p) AS p, sum(r) AS r FROM wp WHERE w <> '' GROUP BY 1, 2)
SELECT id, 2.0::DOUBLE * sum(least(p, r)) / (sum(p) + sum(r)) AS f1 FROM g GROUP BY 1""")
def token_f1(spark, sf):
    b = table(spark, sf, "benchmark")
    pairs = b.select(F.col("item_id").alias("id"), F.col("text").alias("reference")).join(b.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("prediction")), "id")
    return evaluation.token_f1(pairs)


@query("""WITH a AS (SELECT doc_id AS key, md5(text) AS old FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN md5(lower(text)) ELSE md5(text) END AS new FROM documents WHERE doc_id % 11 <> 0)
SELECT key, old, new, CASE WHEN old IS NULL THEN 'ADDED' WHEN new IS NULL THEN 'REMOVED' WHEN old = new THEN 'SAME' ELSE 'CHANGED' END AS verdict FROM a FULL JOIN b USING (key)""")
def run_diff_verdicts(spark, sf):
    d = table(spark, sf, "documents")
    before = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("key"), F.md5("text").alias("value"))
    after = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("key"), F.md5(F.when(F.col("doc_id") % 5 == 0, F.lower("text")).otherwise(F.col("text"))).alias("value"))
    return evaluation.run_diff(before, after)


@query("""WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(x), 6) AS mean FROM u GROUP BY ALL""")
def embedding_zone_centroids(spark, sf):
    return table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def source_support_check(spark, sf):
    return support.holds(table(spark, sf, "documents"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage")))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN s IS NULL THEN 'MODEL_ONLY_REVIEW' WHEN s = o_orderdate THEN 'SOURCE_MATCH' WHEN s < o_orderdate THEN 'DATE_MISMATCH' ELSE 'PARTIAL_MATCH' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def date_status(spark, sf):
    first = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s"))
    j = table(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(first, "o_orderkey", "left")
    state = F.when(F.col("s").isNull(), "MODEL_ONLY_REVIEW").when(F.col("s") == F.col("o_orderdate"), "SOURCE_MATCH").when(F.col("s") < F.col("o_orderdate"), "DATE_MISMATCH").otherwise("PARTIAL_MATCH")
    return j.select(F.col("o_orderkey").alias("doc_id"), state.alias("status"))


@query("SELECT DISTINCT user_id FROM events")
def streaming_feedback_dedup(spark, sf):
    """The events as a stream, each user's first event accepted within the watermark."""
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return feedback.run_once(feedback.accepted_once(stream, "user_id", "ts", "1 day"), "feedback").select("user_id")


_LUHN = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {0}[length({0}) - i + 1]::INT ELSE 2 * {0}[length({0}) - i + 1]::INT - CASE WHEN {0}[length({0}) - i + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


@query(f"""WITH x AS (SELECT c_custkey AS id, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS siren FROM customer),
v AS (SELECT *, 'FR' || lpad(((12 + 3 * (siren::BIGINT % 97)) % 97)::VARCHAR, 2, '0') || siren AS vat FROM x)
SELECT id, siren, {_LUHN.format('siren')} AS registered, vat, id % 3 <> 0 AS vat_valid FROM v""")
def party_identifier_checks(spark, sf):
    """Registrations made of customer keys, their VAT numbers, and the check of those (every third with a wrong key)."""
    siren = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), siren.alias("siren")).withColumn("vat", checksums.vat_of(F.col("siren")))
    wrong = F.concat(F.lit("FR99"), F.col("siren"))  # keys are below 97
    shown = F.when(F.col("id") % 3 == 0, wrong).otherwise(F.col("vat"))
    return rows.select("id", "siren", checksums.registration(F.col("siren")).alias("registered"), "vat", checksums.vat(shown).alias("vat_valid"))


@query("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def explicit_date_normalisation(spark, sf):
    """Order dates printed day first with slashes or year first with points, and read again."""
    date = F.col("o_orderdate")
    printed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(date, "d/M/yyyy")).otherwise(F.date_format(date, "yyyy.MM.dd"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), checksums.iso_date(printed).alias("iso"))
