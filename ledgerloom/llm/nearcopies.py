"""Near-copies by text: SimHash links and MinHash buckets for candidates, exact Jaccard similarity of the five-word shingles to decide.

Two documents are near-copies if the sets of their runs of five words have a Jaccard similarity of at least 0.8; a text of fewer words
has one shingle of all its words. Words are cut at ASCII white space and ASCII letters are folded. ``BANDS`` keys of ``ROWS_PER_BAND``
minima each go to buckets: two texts of similarity s share a bucket but for a chance of (1 - s^6)^30, which at 0.8 is 0.0001.
Every link is checked on the shingle sets themselves, so a bucket decides only what is compared.

The first candidates are those of ``simhash``, by its segment-popcount embedding, grid join under the Manhattan bound and Hamming check: of texts
with one fingerprint all meet the first, and so do the firsts of fingerprints within two bits. As most pairs at 0.8 lie further apart, buckets give the rest.

Texts alike but for case and white space are grouped first, so copies never meet as pairs. Each bucket has a pivot, the text with the most
company in all its buckets, and each text is first compared with the weightiest pivot that it meets; what that links needs no more pairs. Then texts that
lie in another component than their bucket's pivot meet the bucket's other texts. Within that join a lossless bound drops nearly all that can't be alike:
parities of 1024 bits differ in at most as many bits as the sets differ in shingles. Only what is left is compared on the sets. So a large
group of near-copies, whatever hangs on its rim, makes few rows.

Defined cases: null, empty and blank texts are copies of each other; of each component the row with the smallest doc_id stays (a null one only
if there is no other), the one with the smallest hash of its columns if it comes repeated; a text of any length is hashed whole; a null doc_id is kept as such; extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .simhash import components, fingerprint, one_of_each
from .simhash import links as fingerprint_links
from .store import discard, materialise
from .textkit import Words, chunks, kept_by, mix, slices

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS_PER_BAND = 30, 6
#: Bits of a text's parity, kept as so many longs.
PARITY = 1024
WORDS = PARITY // 64
_PARITIES = [f"p{i}" for i in range(WORDS)]
_rng = np.random.default_rng(42)
_FLIP = _rng.integers(0, 1 << 63, BANDS * ROWS_PER_BAND, dtype=np.uint64) * np.uint64(2)
_FACTOR = _rng.integers(0, 1 << 63, BANDS * ROWS_PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def digest(text: bytes | None) -> int:
    """Hash of the folded words; as a signed long with the same bits it names the text."""
    return xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()))


def digests(texts: list[bytes | None]) -> np.ndarray:
    return np.array([digest(t) for t in texts], np.uint64).view(np.int64)


def runs(texts: list[bytes], k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of every shingle, the texts ascending; a long text comes in several parts."""
    texts = [b" ".join(t.split()) for t in texts]
    for buffer, begins, owner in chunks(texts, k - 1):
        piece, h = Words(buffer, begins).shingles(k)
        order = np.argsort(piece, kind="stable")
        yield owner[piece[order]], h[order]


def keys(texts: list[bytes]) -> np.ndarray:
    """The band keys of each text, a row each."""
    least = np.full((len(texts), BANDS * ROWS_PER_BAND), np.iinfo(np.uint64).max, np.uint64)
    for text, h in runs(texts):
        if not len(h):
            continue
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        own = text[starts]
        for i in range(BANDS * ROWS_PER_BAND):
            low = np.minimum.reduceat((h ^ _FLIP[i]) * _FACTOR[i], starts)
            least[own, i] = np.minimum(least[own, i], low)
    total = np.broadcast_to(_BAND, (len(texts), BANDS)).copy()
    for j in range(ROWS_PER_BAND):
        total = mix(total ^ least[:, j::ROWS_PER_BAND])
    return total.view(np.int64)


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for text, h in runs(texts):
        edges = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(h) else []
        for i, part in zip(text[edges], np.split(h, edges[1:]), strict=True) if len(h) else ():
            found[i].append(part)
    return [np.unique(np.concatenate(x)).view(np.int64) if x else np.zeros(0, np.int64) for x in found]


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def with_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, t, fp, keys): the text's digest, its SimHash and its band keys; no keys for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("nearcopies")
        for b in batches:
            for part in slices(b):
                texts = [t or b"" for t in part.column("text").to_pylist()]
                rows = [r if t.strip() else [] for r, t in zip(keys(texts), texts, strict=True)]
                fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests(texts)), pa.array(fps), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "t", "fp", "keys"])

    return _bytes(docs).mapInArrow(run, "doc_id long, t long, fp long, keys array<long>")


def met_by_fingerprint(own: DataFrame) -> DataFrame:
    """(a, b): texts ``own(t, fp)`` with the first text of their fingerprint, and the firsts of fingerprints that ``simhash`` links."""
    groups = materialise(own.groupBy("fp").agg(F.min("t").alias("least"), F.count("*").alias("n")), "fingerprints")
    first = lambda name: groups.select(F.col("fp").alias(name), F.col("least").alias(f"t{name}"))
    linked = fingerprint_links(groups.select("fp"), groups.count()).join(first("a"), "a").join(first("b"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    same = own.select("t", "fp").join(groups.where("n > 1"), "fp").where("t <> least").select(F.col("least").alias("a"), F.col("t").alias("b"))
    return materialise(linked.unionByName(same), "fingerprint-pairs")


def parity(s: np.ndarray) -> np.ndarray:
    """``PARITY`` bits: bit i is set if an odd number of shingles falls on it.

    The bits in which two texts' parities differ are at most as many as the shingles that only one of them has.
    """
    odd = np.bincount((mix(s.view(np.uint64)) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, s, n, p0, p1, ...): the shingle set of each text that ``wanted(t)`` names, its size and its parity."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("nearcopies")
        for b in batches:
            for part in slices(b):
                yield pa.RecordBatch.from_arrays([pa.array(digests(part.column("text").to_pylist())), part.column("text")], ["t", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("nearcopies")
        for b in batches:
            for part in slices(b, 100):
                found = sets([t or b"" for t in part.column("text").to_pylist()])
                bits = np.array([parity(s) for s in found], np.int64).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(found, pa.list_(pa.int64())), pa.array([len(s) for s in found], pa.int32()), *(pa.array(bits[:, i]) for i in range(WORDS))], ["t", "s", "n", *_PARITIES])

    texts = _bytes(docs).select("text").mapInArrow(name, "t long, text binary").join(wanted, "t", "left_semi").groupBy("t").agg(F.min("text").alias("text"))
    return texts.mapInArrow(run, "t long, s array<long>, n int" + "".join(f", {p} long" for p in _PARITIES))


def alike(pairs: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets reach the similarity."""
    left, right = known.select(F.col("t").alias("a"), F.col("s").alias("sa")), known.select(F.col("t").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared, total = F.array_size(F.array_intersect("sa", "sb")), F.array_size("sa") + F.array_size("sb")
    # of integers, as a quotient of exactly 0.8 must count; the sizes alone exclude most of the rest
    bound = round(similarity * 1000)
    fits = F.least(F.array_size("sa"), F.array_size("sb")) * 1000 >= F.greatest(F.array_size("sa"), F.array_size("sb")) * bound
    return both.where(fits).where(shared * 1000 >= (total - shared) * bound).select("a", "b")


def reachable(n: Column, m: Column, parities: list[tuple[Column, Column]], similarity: float = SIMILARITY) -> Column:
    """False if sizes or parities show that two texts can't be alike: no pair that is alike is lost.

    Sets of n and m shingles, d of them in one only, have the similarity (n + m - d) / (n + m + d).
    """
    bound = round(similarity * 1000)
    apart = F.lit(0)
    for a, b in parities:
        apart = apart + F.bit_count(a.bitwiseXOR(b))
    return (F.greatest(apart, F.abs(n - m)) * (1000 + bound)) <= (n + m) * (1000 - bound)


def links(docs: DataFrame, own: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between the distinct texts ``own(t, fp, keys)`` of ``docs`` that connect all near-copies that share a bucket, and those that SimHash brings together."""
    by_fingerprint = met_by_fingerprint(own)
    cells = own.select("t", F.explode("keys").alias("key"))
    met = materialise(cells.join(cells.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "met")
    weighed = materialise(met.join(met.groupBy("t").agg(F.sum("size").alias("w")), "t").select("key", "t", "w"), "weighed")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("w", F.col("t").alias("a"))).alias("pivot"))
    met_pivot = materialise(weighed.join(pivots, "key").select("key", "t", "pivot"), "pivots")
    known = materialise(shingle_sets(docs, met.select("t").union(by_fingerprint.select("a")).union(by_fingerprint.select("b")).distinct()), "sets")
    first = met_pivot.where(F.col("t") != F.col("pivot")["a"]).groupBy(F.col("t").alias("b")).agg(F.max("pivot").alias("pivot")).select(F.col("pivot")["a"].alias("a"), "b")
    first = materialise(first, "first")
    near = materialise(alike(first.unionByName(by_fingerprint).distinct(), known, similarity), "near")
    roots = materialise(components(near), "roots")
    placed = met_pivot.select("key", "t", F.col("pivot")["a"].alias("a")).join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("c", F.coalesce("root", "t")).drop("root")
    placed = placed.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ca")), "a", "left").withColumn("far", F.col("c") != F.coalesce("ca", "a")).drop("a", "ca")
    # buckets whose texts are all in one component need no more pairs
    open_ = placed.where("far").select("key").distinct()
    placed = materialise(placed.join(open_, "key", "left_semi").join(known.drop("s"), "t"), "placed")
    x = placed.where("far").select("key", *(F.col(c).alias(f"{c}_") for c in ("t", "c", "n", *_PARITIES)))
    fits = reachable(F.col("n"), F.col("n_"), [(F.col(p), F.col(f"{p}_")) for p in _PARITIES], similarity)
    rest = x.join(placed, (placed["key"] == x["key"]) & (F.col("c") != F.col("c_")) & (~F.col("far") | (F.col("t") < F.col("t_"))) & fits)
    rest = rest.select(F.least("t", "t_").alias("a"), F.greatest("t", "t_").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(alike(rest.join(done, ["a", "b"], "left_anti"), known, similarity), "rest")
    discard(met, weighed, met_pivot, known, first, placed, roots, by_fingerprint)
    return near.unionByName(rest)


def kept_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, copies) of the row that stays of each component, and how often it is there."""
    prints = materialise(with_keys(docs), "prints")
    rows = prints.groupBy("doc_id", "t").agg(F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copies")).alias("least")
    own = materialise(rows.groupBy("t").agg(least, F.first("fp").alias("fp"), F.first("keys").alias("keys")), "texts")
    roots = materialise(components(links(docs, own.select("t", "fp", "keys"))), "components")
    rooted = own.select("t", "least").join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    stays = rooted.groupBy("root").agg(F.min(F.struct("least.no_id", "least.doc_id", "t", "least.copies")).alias("s")).select("s.doc_id", "s.t", "s.copies")
    return materialise(stays, "stays")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without near-copies: of each component the row with the smallest doc_id stays."""
    stays = kept_rows(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("nearcopies")
        for b in batches:
            for part in slices(b):
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_id"), pa.array(digests(part.column("_text").to_pylist()))], ["_row", "_id", "_t"])

    schema = rows.drop("_text").withColumn("_t", F.lit(0).cast("long")).schema
    kept = rows.mapInArrow(run, schema).join(stays.select("doc_id", "t"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("t")), "left_semi")
    return one_of_each(kept, stays, "_t").select("_row.*")
