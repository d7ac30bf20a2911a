"""Document fingerprints: threshold-scaled sketches of word shingles, and containment between them.

A sketch keeps every shingle hash below a fixed fraction of the hash range. As the threshold is the same for all texts, the union of two
sketches is the sketch of both texts' shingles, and the share of the smaller sketch found in the larger estimates how far the shorter text is contained
in the longer, however unequal they are.

A short text may have no hash below the threshold. Its sketch is empty, and its fingerprint is a tilde and its smallest hash instead: that names the
text, but is no part of a sketch and never merged. Such a text is alike (1.0) to one with the same smallest hash and an empty
sketch too, and unlike (0.0) any other, as a larger sketch can't tell whether it holds the text.

Defined cases: a null text counts as empty; an empty text or one without words has an empty fingerprint, alike (1.0) to
another empty one and unlike (0.0) any other; a text of any length is hashed whole, in pieces; repeated rows and ties of doc_id are ordered by text; a null doc_id
comes before all others; a single document follows itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, chunks, kept_by, slices

#: Words in a shingle, and the fraction of all hashes that a sketch keeps.
SHINGLE, FRACTION = 5, 1 / 8
#: Kept hashes are written with so many bits.
BITS = 48


@dataclass
class Sketch:
    """The hashes below the threshold, sorted and distinct, and the smallest hash of all (None: no words)."""

    hashes: np.ndarray
    least: int | None = None


def sketches(texts: list[bytes], k: int = SHINGLE, fraction: float = FRACTION) -> list[Sketch]:
    """The sketch of each text."""
    limit = np.uint64(int(fraction * 2.0**BITS))
    kept: list[list[np.ndarray]] = [[] for _ in texts]
    least: list[int | None] = [None] * len(texts)
    for buffer, begins, owner in chunks(texts, k - 1):
        piece, h = Words(buffer, begins).shingles(k)
        if not len(h):
            continue
        h = h >> np.uint64(64 - BITS)
        smallest = np.full(len(begins), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(smallest, piece, h)
        below = h < limit
        piece, h = piece[below], h[below]
        order = np.lexsort((h, piece))
        piece, h = piece[order], h[order]
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (h[1:] != h[:-1])
            piece, h = piece[new], h[new]
        at = np.searchsorted(piece, np.arange(len(begins) + 1))
        for p, i in enumerate(owner):
            if at[p] < at[p + 1]:
                kept[i].append(h[at[p] : at[p + 1]])
            if smallest[p] != np.iinfo(np.uint64).max:
                least[i] = int(smallest[p]) if least[i] is None else min(least[i], int(smallest[p]))
    none = np.zeros(0, np.uint64)
    return [Sketch((own[0] if len(own) == 1 else np.unique(np.concatenate(own))) if own else none, low) for own, low in zip(kept, least, strict=True)]


def merge(a: Sketch, b: Sketch) -> Sketch:
    """Sketch of the shingles of two texts together."""
    both = [x for x in (a.least, b.least) if x is not None]
    return Sketch(np.union1d(a.hashes, b.hashes), min(both) if both else None)


def containment(a: Sketch, b: Sketch) -> float:
    """Share of the smaller sketch that the larger holds."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes) and a.least == b.least)
    small, large = (a.hashes, b.hashes) if len(a.hashes) <= len(b.hashes) else (b.hashes, a.hashes)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return float((large[at] == small).sum() / len(small))


def encode(sketch: Sketch) -> str:
    """Six big-endian bytes a hash, in base64: eight characters each; a tilde before the smallest hash where no other is kept."""
    bare = not len(sketch.hashes) and sketch.least is not None
    h = np.array([sketch.least], np.uint64) if bare else sketch.hashes
    return "~" * bare + base64.b64encode(np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def decode(text: str) -> Sketch:
    """What ``encode`` wrote."""
    raw = np.frombuffer(base64.b64decode(text.removeprefix("~")), np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 2:] = raw
    h = full.reshape(-1).view(">u8").astype(np.uint64)
    least = int(h[0]) if len(h) else None
    return Sketch(h[:0], least) if text.startswith("~") else Sketch(h, least)


def fingerprint_documents(docs: DataFrame, k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("fingerprints")
        for b in (part for batch in batches for part in slices(batch)):
            texts = [t or "" for t in b.column("text").to_pylist()]
            prints = [encode(s) for s in sketches([t.encode() for t in texts], k, fraction)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _neighbours(docs: DataFrame, per_bucket: int) -> DataFrame:
    """The documents in buckets of adjoining doc_id, sorted in each, ending with the one that follows the bucket's last.

    Bounds and each bucket's first doc_id come from passes over doc_id alone; there are as many of both as buckets,
    20,000 at most. The texts are shuffled once; only the first document of each bucket is sent twice.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keys = docs.select(key.alias("key"))
    n = keys.count()
    buckets = max(1, min(20_000, n // per_bucket))
    bounds: list[int] = []
    if buckets > 1:
        bounds = sorted(set(keys.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets))).first()[0]))
    edges = np.array(bounds, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.searchsorted(edges, b.column("key").to_numpy()), pa.int32())], ["key", "bucket"])

    first = {r["bucket"]: r["least"] for r in keys.mapInArrow(place, "key long, bucket int").groupBy("bucket").agg(F.min("key").alias("least")).collect()}
    used = sorted(first)
    before = {first[used[(i + 1) % len(used)]]: b for i, b in enumerate(used)}  # a bucket's first document also ends the bucket before it
    firsts = np.array(list(before), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("key").to_numpy()
            again = np.flatnonzero(np.isin(own, firsts))
            bucket = np.concatenate((np.searchsorted(edges, own), [before[int(x)] for x in own[again]])).astype(np.int32)
            rows = pa.Table.from_batches([b]).take(pa.array(np.concatenate((np.arange(len(own)), again))))
            rows = rows.append_column("bucket", pa.array(bucket)).append_column("guest", pa.array((np.arange(len(bucket)) >= len(own)).astype(np.int32)))
            yield from rows.combine_chunks().to_batches()

    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(deal, "key long, doc_id long, text string, bucket int, guest int")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "guest", "key", "text").select("doc_id", "text", "guest")


def compare_with_edits(docs: DataFrame, k: int = SHINGLE, fraction: float = FRACTION, per_bucket: int = 256) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half comes from the next document's beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("fingerprints")
        held: list[tuple] = []
        for b in (part for batch in batches for part in slices(batch)):
            rows = held + list(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("guest").to_pylist(), strict=True))
            held = rows[-1:]
            yield from compared(rows)

    def compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = sketches([r[1].encode() for r in rows], k, fraction)
        at = [i for i in range(len(rows) - 1) if not rows[i][2]]
        edited = []
        for i in at:
            text, half = rows[i][1], len(rows[i][1]) // 2
            edited.append((text[: len(text) - half] + rows[i + 1][1][:half]).encode())
        changed = sketches(edited, k, fraction)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in at], pa.int64()),
                pa.array([len(rows[i][1]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([encode(own[i]) for i in at], pa.string()),
                pa.array([encode(s) for s in changed], pa.string()),
                pa.array([containment(own[i], s) for i, s in zip(at, changed, strict=True)], pa.float64()),
                pa.array([containment(own[i], own[i + 1]) for i in at], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return _neighbours(docs, per_bucket).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
