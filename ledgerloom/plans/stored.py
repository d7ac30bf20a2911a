"""Queries of the annotation store: listings, revisions, masks, transfers, the queue of training runs, exports, feedback and campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as S
from .registry import query, table


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 10")
def store_document_listing(spark, sf):
    return S.listed(table(spark, sf, "events"), [F.desc("ts"), F.asc("event_id")], 20, 10, F.col("event_type") == "click").select("event_id", "event_type", "user_id")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def store_latest_events(spark, sf):
    return S.listed(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "ts", "user_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def store_last_event(spark, sf):
    return S.last(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


_MASK = ["p_partkey AS mask_id", "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name", "p_size AS version", "p_type AS document_type"]


@query(f"SELECT mask_id, version, document_type FROM (SELECT {', '.join(_MASK)} FROM part) QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY version DESC, mask_id DESC) = 1")
def store_latest_masks(spark, sf):
    return S.latest_masks(table(spark, sf, "part").selectExpr(*_MASK)).select("mask_id", "version", "document_type")


@query(f"""WITH m AS (SELECT {', '.join(_MASK)} FROM part), t AS (SELECT lower(name) AS k, max(version) AS top FROM m WHERE mask_id % 3 <> 0 GROUP BY 1)
SELECT mask_id, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY lower(name) ORDER BY mask_id) AS INT) AS version FROM m LEFT JOIN t ON k = lower(name) WHERE mask_id % 3 = 0""")
def store_next_versions(spark, sf):
    m = table(spark, sf, "part").selectExpr(*_MASK)
    return S.next_versions(m.where("mask_id % 3 <> 0"), m.where("mask_id % 3 = 0").drop("version").withColumn("ix", F.col("mask_id"))).select("mask_id", "version")


_REVISION = ["o_custkey AS doc_id", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision", "concat('d', CAST(o_orderkey % 4 AS STRING)) AS digest", "o_orderkey AS k"]


@query(f"""WITH r AS (SELECT {', '.join(_REVISION)} FROM orders), s AS (SELECT *, max(revision) OVER (PARTITION BY doc_id) AS top FROM r), n AS (SELECT doc_id, top AS now, digest AS now_digest FROM s WHERE revision = top),
w AS (SELECT o_orderkey AS ix, o_custkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN now WHEN 1 THEN now - 1 ELSE NULL END AS er, 'd' || (o_orderkey % 5) AS digest, now, now_digest FROM orders JOIN n ON n.doc_id = o_custkey),
f AS (SELECT *, er IS NULL OR er = now AS fits, digest = now_digest AS same FROM w), g AS (SELECT *, fits AND NOT same AND ix = min(ix) FILTER (fits AND NOT same) OVER (PARTITION BY doc_id) AS first FROM f)
SELECT doc_id, ix, CASE WHEN fits AND same THEN 'UNCHANGED' WHEN first THEN 'SAVED' ELSE 'CONFLICT' END AS verdict, CASE WHEN fits AND same THEN now WHEN first THEN now + 1 END AS revision FROM g""")
def store_revision_appends(spark, sf):
    stored = table(spark, sf, "orders").selectExpr(*_REVISION)
    now = stored.groupBy("doc_id").agg(F.max("revision").alias("now"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ix"), F.concat(F.lit("d"), (F.col("o_orderkey") % 5).cast("string")).alias("digest")).join(now, "doc_id")
    expected = F.when(F.col("ix") % 3 == 0, F.col("now")).when(F.col("ix") % 3 == 1, F.col("now") - 1)
    return S.append_revisions(stored, new.withColumns({"expected_revision": expected, "expected_digest": F.lit(None).cast("string")}).drop("now"))


@query(f"""WITH r AS (SELECT {', '.join(_REVISION)} FROM orders), s AS (SELECT *, revision <> row_number() OVER w AS gap, digest = lag(digest) OVER w AS same FROM r WHERE k % 17 <> 0 WINDOW w AS (PARTITION BY doc_id ORDER BY revision))
SELECT doc_id, count(*) AS revisions, count(*) FILTER (gap) = 0 AS whole, count(*) FILTER (same) AS repeats, arg_max(digest, revision) AS digest FROM s GROUP BY 1""")
def store_revision_history(spark, sf):
    return S.revision_history(table(spark, sf, "orders").selectExpr(*_REVISION).where("k % 17 <> 0"))


_RUN = ["event_id % 400 AS run_id", "ts AS moment", "CASE WHEN event_id % 41 = 0 THEN 'finished' WHEN event_id % 43 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'heartbeat' WHEN event_id % 3 = 1 THEN 'claimed' ELSE 'queued' END AS kind", "concat('w', CAST(event_id % 5 AS STRING)) AS worker", "CAST(event_id % 100 AS INT) AS step"]
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_STATES = f"""WITH e AS (SELECT {', '.join(_RUN)} FROM events), q AS (SELECT run_id, min(moment) FILTER (kind = 'queued') AS created_at, max(step) FILTER (kind = 'heartbeat') AS steps, arg_min(kind, moment) FILTER (kind IN ('finished', 'failed')) AS ended, arg_max(kind, moment) FILTER (kind NOT IN ('finished', 'failed')) AS live, arg_max(worker, moment) FILTER (kind NOT IN ('finished', 'failed')) AS w, max(moment) FILTER (kind NOT IN ('finished', 'failed')) AS seen FROM e GROUP BY 1),
s AS (SELECT *, live IN ('claimed', 'heartbeat') AS running, live IN ('claimed', 'heartbeat') AND epoch({_NOW}) - floor(epoch(seen)) > 86400 AS stale FROM q),
r AS (SELECT run_id, created_at, CASE WHEN ended = 'finished' THEN 'DONE' WHEN ended = 'failed' THEN 'FAILED' WHEN stale THEN 'QUEUED' WHEN running THEN 'RUNNING' ELSE 'QUEUED' END AS state, w, coalesce(steps, 0) AS steps, coalesce(stale, false) AND ended IS NULL AS recovered FROM s)"""


@query(_STATES + " SELECT run_id, state, CASE WHEN state = 'RUNNING' THEN w END AS worker, steps, recovered FROM r")
def queue_states(spark, sf):
    return S.run_states(table(spark, sf, "events").selectExpr(*_RUN), F.expr(_NOW), 86400).select("run_id", "state", "worker", "steps", "recovered")


@query(_STATES + " SELECT run_id, ['x', 'y', 'z'][n] AS worker FROM (SELECT run_id, row_number() OVER (ORDER BY created_at NULLS FIRST, run_id) AS n FROM r WHERE state = 'QUEUED') WHERE n <= 3")
def queue_claims(spark, sf):
    return S.claims(S.run_states(table(spark, sf, "events").selectExpr(*_RUN), F.expr(_NOW), 86400), ["x", "y", "z"])


@query("SELECT c_custkey AS request_id, c_nationkey AS dataset_id, c_mktsegment AS family, CASE WHEN c_nationkey >= 20 THEN 'UNKNOWN_DATASET' WHEN c_nationkey % 3 = 0 THEN 'QUEUED' ELSE 'DATASET_NOT_READY' END AS verdict FROM customer")
def queue_requests(spark, sf):
    sets = table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("dataset_id"), F.when(F.col("n_nationkey") % 3 == 0, "READY").otherwise("DRAFT").alias("status"))
    return S.enqueue(sets, table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("dataset_id"), F.col("c_mktsegment").alias("family")))


_CHUNK = ["o_custkey AS transfer_id", "CAST(10 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS BIGINT) AS start", "10 AS size", "concat('s', CAST(o_orderkey AS STRING)) AS sha256", "o_orderkey AS k"]


@query(f"""WITH c AS (SELECT {', '.join(_CHUNK)} FROM orders), s AS (SELECT transfer_id, start, k FROM c WHERE k % 29 <> 0), d AS (SELECT c_custkey AS transfer_id, 10 * (SELECT count(*) FROM c WHERE transfer_id = c_custkey) + CASE c_custkey % 10 WHEN 3 THEN 5 WHEN 4 THEN -5 ELSE 0 END AS size FROM customer),
g AS (SELECT transfer_id, count(*) * 10 AS got, max(start) = 10 * (count(*) - 1) AS whole, bool_or(k % 37 = 0) AS clash, count(*) FILTER (k % 5 = 0 OR k % 37 = 0) AS retries FROM s GROUP BY 1)
SELECT transfer_id, CASE WHEN got IS NULL THEN 'EMPTY' WHEN clash THEN 'CONFLICT' WHEN NOT whole THEN 'GAP' WHEN got = size THEN 'COMPLETE' WHEN got > size THEN 'TOO_LARGE' ELSE 'PARTIAL' END AS verdict, coalesce(got, 0) AS received, coalesce(retries, 0) AS retries FROM d LEFT JOIN g USING (transfer_id)""")
def store_transfers(spark, sf):
    c = table(spark, sf, "orders").selectExpr(*_CHUNK)
    sent = c.where("k % 29 <> 0")
    again = sent.where("k % 5 = 0 OR k % 37 = 0").withColumn("sha256", F.when(F.col("k") % 37 == 0, "other").otherwise(F.col("sha256")))
    sizes = c.groupBy("transfer_id").agg((F.count("*") * 10).alias("n"))
    declared = table(spark, sf, "customer").select(F.col("c_custkey").alias("transfer_id")).join(sizes, "transfer_id", "left").select("transfer_id", (F.coalesce("n", F.lit(0)) + F.when(F.col("transfer_id") % 10 == 3, 5).when(F.col("transfer_id") % 10 == 4, -5).otherwise(0)).alias("size"))
    return S.transfers(sent.unionByName(again), declared)


@query("""WITH r AS (SELECT conv_id AS doc_id, turn AS ix, CASE WHEN turn % 5 = 4 THEN turn - 2 ELSE turn END AS revision, CASE WHEN (conv_id + turn) % 9 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END = sha256(coalesce(text, '')) AS same FROM conversations)
SELECT doc_id, bool_and(up) AS ordered, bool_and(same) AS digests_match FROM (SELECT *, coalesce(revision > lag(revision) OVER (PARTITION BY doc_id ORDER BY ix), true) AS up FROM r) GROUP BY 1""")
def store_bundles(spark, sf):
    c = table(spark, sf, "conversations")
    payload = F.coalesce("text", F.lit(""))
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ix"), F.when(F.col("turn") % 5 == 4, F.col("turn") - 2).otherwise(F.col("turn")).alias("revision"), payload.alias("payload"), F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, "x").otherwise(F.sha2(payload, 256)).alias("digest"))
    return S.bundle_checks(rows)


@query("""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'MISSING' WHEN doc_id % 17 = 0 THEN 'EXTRA' WHEN doc_id % 11 = 0 THEN 'CHANGED' ELSE 'VERIFIED' END AS verdict FROM documents WHERE NOT (doc_id % 13 = 0 AND doc_id % 17 = 0)""")
def store_export_check(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("payload"))
    manifest = d.where("doc_id % 17 <> 0").select("doc_id", F.sha2("payload", 256).alias("sha256"))
    rows = d.where("doc_id % 13 <> 0").withColumn("payload", F.when(F.col("doc_id") % 11 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return S.export_check(manifest, rows)


_FEEDBACK = [
    "event_id", "CASE WHEN event_id % 11 = 1 THEN 2 ELSE 1 END AS schema_version", "CASE WHEN event_id % 11 = 2 THEN 'short' ELSE concat('annotation-', CAST(event_id AS STRING)) END AS annotation_id", "CASE WHEN event_id % 11 = 3 THEN '{}' ELSE props END AS extraction", "CASE WHEN event_id % 11 = 4 THEN '[]' ELSE props END AS corrections",
    "CASE WHEN event_id % 11 = 5 THEN 'sha256:1' ELSE concat('SHA256:', repeat('a', 64)) END AS document_sha256", "CASE WHEN event_id % 11 = 6 THEN 'machine' ELSE 'Human_Validated' END AS status", "CASE WHEN event_id % 11 = 7 THEN ' ' ELSE 'me' END AS reviewed_by", "CASE WHEN event_id % 11 = 8 THEN NULL ELSE 'studio' END AS source",
    "CASE WHEN event_id % 11 = 9 THEN '2024-01-01T00:00:00' ELSE '2024-01-01T00:00:00Z' END AS reviewed_at",
]


@query("""SELECT event_id, CASE event_id % 11 WHEN 1 THEN 'schema_version' WHEN 2 THEN 'annotation_id' WHEN 3 THEN 'extraction' WHEN 4 THEN 'corrections' WHEN 5 THEN 'document_sha256' WHEN 6 THEN 'validation.status' WHEN 7 THEN 'validation.reviewed_by' WHEN 8 THEN 'validation.source' WHEN 9 THEN 'validation.reviewed_at' END AS problem FROM events""")
def feedback_validation(spark, sf):
    return S.feedback_verdicts(table(spark, sf, "events").selectExpr(*_FEEDBACK)).select("event_id", "problem")


@query("""WITH e AS (SELECT user_id AS id, event_id AS ix, event_type AS d FROM events), f AS (SELECT *, d <> arg_min(d, ix) OVER (PARTITION BY id) AS other, row_number() OVER (PARTITION BY id, d ORDER BY ix) AS n FROM e)
SELECT id AS annotation_id, CASE WHEN other THEN 'REJECTED' WHEN n = 1 THEN 'ACCEPTED' ELSE 'IGNORED' END AS verdict, count(*) AS n FROM f GROUP BY ALL""")
def feedback_acceptance(spark, sf):
    return S.accept_feedback(table(spark, sf, "events").select(F.col("user_id").alias("annotation_id"), F.col("event_id").alias("ix"), F.col("event_type").alias("digest")))


@query("SELECT DISTINCT c_nationkey AS batch FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 12)")
def campaign_resume(spark, sf):
    return S.resume(table(spark, sf, "customer").select(F.col("c_nationkey").alias("batch")).distinct(), table(spark, sf, "supplier").where("s_suppkey < 12").select(F.col("s_nationkey").alias("batch")))


@query("""WITH o AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)), n AS (SELECT greatest(1, CAST(ceil(count(*) / 25) AS BIGINT)) AS n FROM o)
SELECT s AS sha256, CAST(floor(('0x' || substr(sha256('7:' || s), 1, 12))::BIGINT / 281474976710656 * n) AS INT) AS batch FROM o, n""")
def campaign_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return S.batched(d, d.where("doc_id % 10 = 0"), 7, 25)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT o_orderkey + 100000000, 'Z' FROM orders WHERE o_orderkey % 5 = 0")
def campaign_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 5 = 0").withColumn("status", F.lit("Z"))
    return S.upsert(o, new.unionByName(new.withColumn("o_orderkey", F.col("o_orderkey") + 100000000)), ["o_orderkey"])


@query("""SELECT sha256(text) AS sha256, CASE WHEN bool_or(doc_id % 3 = 0) THEN 'EVALUATED' WHEN bool_or(doc_id % 3 = 1) THEN 'DUPLICATE' ELSE 'UNACCOUNTED' END AS verdict FROM documents GROUP BY 1""")
def campaign_accounting(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return S.accounted(d, d.where("doc_id % 3 = 0"), d.where("doc_id % 3 = 1"))
