"""An annotation store as tables: documents, append-only revisions, versioned masks and datasets, chunks of transfers, and a queue of training runs.

Every write is a row of an event table; what a row store keeps as state is read from the events: the last one of each key, by one
aggregate. Listings are ordered and bounded by their limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.judgements import ladder


def last(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key in a stated order."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e")).select(*keys, *(F.col(f"_e.{c}").alias(c) for c in rest))


def listed(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
    """A page of a listing."""
    kept = rows.where(where) if where is not None else rows
    return kept.orderBy(*order).offset(offset).limit(limit)


def latest_masks(masks: DataFrame, document_type: str | None = None) -> DataFrame:
    """The highest version of each mask's name, whatever its case."""
    kept = masks.where(F.col("document_type") == document_type) if document_type else masks
    return last(kept.withColumn("_name", F.lower("name")), ["_name"], ["version", "mask_id"]).drop("_name")


def next_versions(rows: DataFrame, new: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """New rows with the versions that follow those in store, in their order ``ix``, names compared without case."""
    key = F.lower(F.col(name))
    top = rows.groupBy(key.alias("_k")).agg(F.max(version).alias("_top"))
    place = F.row_number().over(W.partitionBy("_k").orderBy("ix"))
    return new.withColumn("_k", key).join(top, "_k", "left").withColumn(version, (F.coalesce("_top", F.lit(0)) + place).cast("int")).drop("_k", "_top")


def append_revisions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Verdicts on new revisions (doc_id, ix, expected_revision, expected_digest, digest) against the stored (doc_id, revision, digest).

    One new revision a document is taken: the first whose expected revision and digest are those of the last stored. It gets the next
    number; the same digest again is no change; all others conflict.
    """
    now = stored.groupBy("doc_id").agg(F.max_by("digest", "revision").alias("now_digest"), F.max("revision").alias("now"))
    rows = new.join(now, "doc_id", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    fits = F.coalesce((F.col("expected_revision").isNull() | (F.col("expected_revision") == F.col("now"))) & (F.col("expected_digest").isNull() | F.col("expected_digest").eqNullSafe(F.col("now_digest"))), F.lit(False))
    same = F.coalesce(F.col("digest") == F.col("now_digest"), F.lit(False))
    first = fits & ~same & (F.min(F.when(fits & ~same, F.col("ix"))).over(W.partitionBy("doc_id")) == F.col("ix"))
    verdict = ladder((fits & same, "UNCHANGED"), (first, "SAVED"), otherwise="CONFLICT")
    return rows.select("doc_id", "ix", verdict.alias("verdict"), F.when(verdict == "SAVED", F.col("now") + 1).when(verdict == "UNCHANGED", F.col("now")).alias("revision"))


def revision_history(revisions: DataFrame) -> DataFrame:
    """Each document's revisions: how many, whether they run from 1 without a gap and each digest differs from the one before."""
    order = W.partitionBy("doc_id").orderBy("revision")
    rows = revisions.withColumns({"_gap": F.col("revision") != F.row_number().over(order), "_same": F.col("digest") == F.lag("digest").over(order)})
    return rows.groupBy("doc_id").agg(F.count("*").alias("revisions"), (F.count_if(F.col("_gap")) == 0).alias("whole"), F.count_if(F.col("_same")).alias("repeats"), F.max_by("digest", "revision").alias("digest"))


def run_states(events: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """The state of each training run from its events (run_id, moment, kind, worker, step): QUEUED, RUNNING, DONE or FAILED.

    Kinds are queued, claimed, heartbeat, finished and failed. A running one without an event for ``stale_seconds`` is queued again; after the end nothing changes.
    """
    ended = F.min(F.when(F.col("kind").isin("finished", "failed"), F.struct("moment", "kind"))).alias("e")
    live = F.max(F.when(~F.col("kind").isin("finished", "failed"), F.struct("moment", "kind", "worker", "step"))).alias("l")
    per = events.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "queued", F.col("moment"))).alias("created_at"), F.max(F.when(F.col("kind") == "heartbeat", F.col("step"))).alias("steps"), ended, live)
    running = F.col("l.kind").isin("claimed", "heartbeat")
    stale = running & (F.unix_timestamp(now) - F.unix_timestamp("l.moment") > stale_seconds)
    state = ladder((F.col("e.kind") == "finished", "DONE"), (F.col("e.kind") == "failed", "FAILED"), (stale, "QUEUED"), (running, "RUNNING"), otherwise="QUEUED")
    return per.select("run_id", "created_at", state.alias("state"), F.when(state == "RUNNING", F.col("l.worker")).alias("worker"), F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce(stale & F.col("e").isNull(), F.lit(False)).alias("recovered"))


def claims(states: DataFrame, workers: list[str]) -> DataFrame:
    """(run_id, worker): the oldest queued runs, one for each free worker in order."""
    oldest = states.where("state = 'QUEUED'").orderBy("created_at", "run_id").limit(len(workers))
    place = F.row_number().over(W.orderBy("created_at", "run_id"))  # as many rows as workers
    return oldest.withColumn("_n", place).select("run_id", F.get(F.array(*map(F.lit, workers)), F.col("_n") - 1).alias("worker"))


def enqueue(datasets: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests for training (request_id, dataset_id, family): QUEUED if their dataset is READY, else why not."""
    known = datasets.select("dataset_id", F.col("status").alias("_status"))
    rows = requests.join(known, "dataset_id", "left")
    return rows.select("request_id", "dataset_id", "family", ladder((F.col("_status") == "READY", "QUEUED"), (F.col("_status").isNull(), "UNKNOWN_DATASET"), otherwise="DATASET_NOT_READY").alias("verdict"))


def transfers(chunks: DataFrame, declared: DataFrame) -> DataFrame:
    """Whether resumed uploads are whole: chunks (transfer_id, start, size, sha256) cover the declared (transfer_id, size) without gap or overlap; an exact retry is no fault."""
    once = chunks.groupBy("transfer_id", "start").agg(F.min("size").alias("size"), F.count_distinct("size", "sha256").alias("versions"), F.count("*").alias("sent"))
    follows = F.coalesce(F.lag(F.col("start") + F.col("size")).over(W.partitionBy("transfer_id").orderBy("start")), F.lit(0))
    per = once.withColumn("_ok", F.col("start") == follows).groupBy("transfer_id").agg((F.count_if(~F.col("_ok")) == 0).alias("contiguous"), F.sum("size").alias("received"), (F.max("versions") > 1).alias("conflict"), F.sum(F.col("sent") - 1).alias("retries"))
    rows = declared.select("transfer_id", F.col("size").alias("declared")).join(per, "transfer_id", "left")
    verdict = ladder((F.col("received").isNull(), "EMPTY"), (F.col("conflict"), "CONFLICT"), (~F.col("contiguous"), "GAP"), (F.col("received") == F.col("declared"), "COMPLETE"), (F.col("received") > F.col("declared"), "TOO_LARGE"), otherwise="PARTIAL")
    return rows.select("transfer_id", verdict.alias("verdict"), F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("retries", F.lit(0)).alias("retries"))


def bundle_checks(revisions: DataFrame) -> DataFrame:
    """(doc_id, ordered, digests_match) of bundles (doc_id, ix, revision, payload, digest): revisions rise strictly, and digests are the payloads' SHA-256."""
    before = F.lag("revision").over(W.partitionBy("doc_id").orderBy("ix"))
    rows = revisions.withColumns({"_up": F.coalesce(F.col("revision") > before, F.lit(True)), "_same": F.sha2("payload", 256) == F.col("digest")})
    return rows.groupBy("doc_id").agg(F.bool_and("_up").alias("ordered"), F.bool_and("_same").alias("digests_match"))


def export_check(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, verdict) of an export against its manifest (doc_id, sha256): VERIFIED, CHANGED, MISSING or EXTRA; rows have doc_id and payload."""
    there = rows.select("doc_id", F.sha2("payload", 256).alias("now"))
    both = manifest.select("doc_id", "sha256").join(there, "doc_id", "full")
    return both.select("doc_id", ladder((F.col("now").isNull(), "MISSING"), (F.col("sha256").isNull(), "EXTRA"), (F.col("now") == F.col("sha256"), "VERIFIED"), otherwise="CHANGED").alias("verdict"))


def feedback_verdicts(feedback: DataFrame) -> DataFrame:
    """Adds ``problem`` (null if it may be learnt from) to feedback (schema_version, annotation_id, extraction, corrections, document_sha256, status, reviewed_by, source, reviewed_at).

    Texts are JSON where they hold objects. The first rule that is broken is named.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    sha = F.regexp_replace(F.lower(text("document_sha256")), "^sha256:", "")
    empty = lambda c: text(c).isin("", "{}", "[]", "null")
    zoned = text("reviewed_at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})$")
    problem = ladder(
        (~F.col("schema_version").eqNullSafe(F.lit(1)), "schema_version"), (~text("annotation_id").rlike("^[A-Za-z0-9._:-]{8,128}$"), "annotation_id"), (empty("extraction"), "extraction"), (empty("corrections"), "corrections"), (~sha.rlike("^[0-9a-f]{64}$"), "document_sha256"),
        (F.lower(text("status")) != "human_validated", "validation.status"), (~F.length(text("reviewed_by")).between(1, 160), "validation.reviewed_by"), (~F.length(text("source")).between(1, 120), "validation.source"), (~zoned, "validation.reviewed_at"),
    )
    return feedback.withColumn("problem", problem)


def accept_feedback(events: DataFrame) -> DataFrame:
    """(annotation_id, verdict, n): the same digest again is ignored, another digest for an id that is known is rejected. Events have annotation_id, ix and digest."""
    first = F.min_by("digest", "ix").over(W.partitionBy("annotation_id"))
    seen = F.row_number().over(W.partitionBy("annotation_id", "digest").orderBy("ix"))
    rows = events.withColumns({"_first": first, "_seen": seen})
    verdict = ladder((F.col("digest") != F.col("_first"), "REJECTED"), (F.col("_seen") == 1, "ACCEPTED"), otherwise="IGNORED")
    return rows.groupBy("annotation_id", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def resume(batches: DataFrame, done: DataFrame) -> DataFrame:
    """Batches that no record of ``done`` names."""
    return batches.join(done.select("batch").distinct(), "batch", "left_anti")


def batched(documents: DataFrame, excluded: DataFrame, seed: int, size: int) -> DataFrame:
    """(sha256, batch): each content once, without the excluded, in an order that the seed fixes, dealt to numbered batches of about ``size`` by ranges of its hash."""
    once = documents.select("sha256").distinct().join(excluded.select("sha256"), "sha256", "left_anti").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "sha256"), 256))
    n = max(1, -(-once.count() // size))
    u = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / float(1 << 48)
    return once.select("sha256", F.floor(u * n).cast("int").alias("batch"))


def upsert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``new`` in place of theirs."""
    return rows.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def accounted(inventory: DataFrame, evaluated: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(sha256, verdict): how each file of an inventory is accounted for; UNACCOUNTED is a fault of the campaign."""
    marks = evaluated.select("sha256", F.lit("EVALUATED").alias("m")).unionByName(duplicates.select("sha256", F.lit("DUPLICATE").alias("m"))).groupBy("sha256").agg(F.max("m").alias("m"))
    return inventory.select("sha256").distinct().join(marks, "sha256", "left").select("sha256", F.coalesce("m", F.lit("UNACCOUNTED")).alias("verdict"))
