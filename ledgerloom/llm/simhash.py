"""SimHash near-duplicates: segment-popcount embedding, grid range-join under Manhattan distance, exact check.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. A differing bit changes one count by at most
one, so the Manhattan distance of two embeddings is a lower bound of the Hamming distance. The range join "Manhattan
distance of at most d" runs on a grid: the coordinates are dealt to ``d + keep`` bands, and two vectors within d agree exactly
on at least ``keep`` of them, so each fingerprint goes to one cell for each choice of ``keep`` bands and meets there all
that lie within d. In a cell the Manhattan distance filters, then the Hamming distance decides.

Equal fingerprints are grouped first, so copies never meet as pairs. A cell with more than ``DENSE`` fingerprints isn't paired: the grid is refined there
with further segments, up to cells that fix the counts of all segments but ``d``, where vectors within d still meet. Only what is crowded even
there, fingerprints that swap bits within segments by the hundred, goes to exact wildcard groups (every choice of d bits masked out), where all members of a group are
within d of each other and a star to the smallest one keeps them connected: linear in the members, with no link lost
between groups. Components are found by alternating large-star and small-star steps on tables written to shared storage.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; a text of any length is read whole; repeated rows and ties share a
fingerprint; a null doc_id is kept and joins its group, whose id is the smallest non-null doc_id (null if it has none); extra columns are
ignored by ``link_documents`` and kept by ``deduplicate``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_counted
from .store import discard, materialise
from .textkit import kept_by, slices

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: A cell with more fingerprints is linked through wildcard groups.
DENSE = 256
_LOW = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 hashes."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - k + 1)
    totals, n = np.zeros(64, np.int64), 0
    for at in range(0, last, 65536):
        stop = min(at + 65536, last)
        h = np.array([digest(b" ".join(words[i : i + k]), seed) for i in range(at, stop)], "<u8")
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("simhash")
        for b in batches:
            values = np.array([fingerprint(t or b"", k, seed) for part in slices(b) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments, two bits each."""
    return (fp & _LOW) + ((fp >> np.uint64(1)) & _LOW)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of embeddings: counts 0, 1, 2 differ by one if their codes' low bits differ, by two if only the high ones do."""
    x = a ^ b
    return np.bitwise_count(x & _LOW).astype(np.int64) + 2 * np.bitwise_count((x >> np.uint64(1)) & ~x & _LOW)


def bands_kept(n: int) -> int:
    """How many bands a cell fixes: more for more fingerprints, so that chance meetings stay below about one each.

    A two-bit segment holds 1.4 bits of information. This sets the cost only; every choice finds the same links.
    """
    for keep in (3, 4, 6, 8):
        pairs = len(list(combinations(range(keep + DISTANCE), keep)))
        if n * pairs / 2 ** (1.4 * 32 * keep / (keep + DISTANCE)) < 1:
            break
    return keep


def coarse_masks(keep: int, distance: int) -> list[int]:
    """The bits that each grid's cells fix: every choice of ``keep`` of ``distance + keep`` bands of segments."""
    edges = np.linspace(0, 32, keep + distance + 1).astype(int)
    return [sum(3 << (2 * s) for band in chosen for s in range(edges[band], edges[band + 1])) for chosen in combinations(range(keep + distance), keep)]


def fine_masks(distance: int) -> list[int]:
    """As above, for cells that fix all segments but ``distance``."""
    return [((1 << 64) - 1) & ~sum(3 << (2 * s) for s in left) for left in combinations(range(32), distance)]


def links(fps: DataFrame, n: int, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """(a, b), a < b by signed value: links between distinct fingerprints ``fps(fp)`` that connect all within ``distance``."""
    near = None
    for masks in (coarse_masks(bands_kept(n), distance), fine_masks(distance)):
        found = materialise(gridded(fps, masks, distance, dense), "meet")
        linked = found.where("b IS NOT NULL")
        near = linked if near is None else near.unionByName(linked)
        fps = materialise(found.where("b IS NULL").select(F.col("a").alias("fp")).distinct(), "crowded")
        if not fps.limit(1).count():
            return near.distinct()
    return near.unionByName(wildcard_links(fps, distance)).distinct()


def gridded(fps: DataFrame, masks: list[int], distance: int, dense: int) -> DataFrame:
    """(a, b): links within the cells of grids that fix these bits of the embedding; (fp, null) for each fingerprint in a dense cell."""
    masks_ = np.array(masks, np.uint64)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                fp = b.column("fp").slice(at, 2_000).to_numpy()
                at_grid = embed(fp.view(np.uint64))[:, None] & masks_[None, :]
                grid = np.broadcast_to(np.arange(len(masks_), dtype=np.int32), at_grid.shape)
                yield pa.RecordBatch.from_arrays([pa.array(grid.reshape(-1)), pa.array(at_grid.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, len(masks_)))], ["grid", "cell", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by cell: links of small cells; (fp, null) for each fingerprint of a dense one."""
        grid = cell = fp = np.zeros(0, np.int64)
        flowing = None  # the dense cell whose rows are passing by

        def pairs(c: np.ndarray, f: np.ndarray, new: np.ndarray):
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(f)))
            found_a, found_b = [], []
            for size in np.unique(sizes):
                if size < 2:
                    continue
                members = f[starts[sizes == size][:, None] + np.arange(size)[None, :]]
                if size > dense:
                    found_a.append(members.reshape(-1))
                    found_b.append(None)
                    continue
                i, j = np.triu_indices(int(size), 1)
                step = max(1, 2_000_000 // len(i))
                for at in range(0, len(members), step):
                    x, y = members[at : at + step][:, i].reshape(-1), members[at : at + step][:, j].reshape(-1)
                    ux, uy = x.view(np.uint64), y.view(np.uint64)
                    near = manhattan(embed(ux), embed(uy)) <= distance
                    x, y, ux, uy = x[near], y[near], ux[near], uy[near]
                    near = np.bitwise_count(ux ^ uy) <= distance
                    found_a.append(np.minimum(x[near], y[near]))
                    found_b.append(np.maximum(x[near], y[near]))
            return found_a, found_b

        def out(found_a, found_b):
            for a, b in zip(found_a, found_b, strict=True):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())], ["a", "b"])

        for b in batches:
            grid, cell, fp = (np.concatenate((old, b.column(c).to_numpy().astype(np.int64))) for old, c in ((grid, "grid"), (cell, "cell"), (fp, "fp")))
            if not len(fp):
                continue
            new = np.ones(len(fp), bool)
            new[1:] = (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])
            if flowing is not None:
                same = (grid == flowing[0]) & (cell == flowing[1])
                if same.any():
                    yield from out([fp[same]], [None])
                    grid, cell, fp, new = grid[~same], cell[~same], fp[~same], new[~same]
                    if len(new):
                        new[0] = True
                if not len(fp):
                    continue
                flowing = None
            last = np.flatnonzero(new)[-1]
            yield from out(*pairs(cell[:last], fp[:last], new[:last])) if last else ()
            grid, cell, fp = grid[last:], cell[last:], fp[last:]
            if len(fp) > dense:
                flowing = (grid[0], cell[0])
                yield from out([fp], [None])
                grid, cell, fp = grid[:0], cell[:0], fp[:0]
        if len(fp):
            first = np.zeros(len(fp), bool)
            first[0] = True
            yield from out(*pairs(cell, fp, first))

    return fps.mapInArrow(cells, "grid int, cell long, fp long").repartition("grid", "cell").sortWithinPartitions("grid", "cell").mapInArrow(meet, "a long, b long")


def wildcard_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Stars that connect all of ``fps`` within ``distance``: members of a group agree on all but ``distance`` given bits."""
    masks = []
    for bits in combinations(range(64), distance):
        m = (1 << 64) - 1
        for i in bits:
            m &= ~(1 << i)
        masks.append(m)
    masks_ = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                fp = b.column("fp").slice(at, 100).to_numpy()
                left = fp.view(np.uint64)[:, None] & masks_[None, :]
                bits = np.broadcast_to(np.arange(len(masks_), dtype=np.int32), left.shape)
                yield pa.RecordBatch.from_arrays([pa.array(bits.reshape(-1)), pa.array(left.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, len(masks_)))], ["bits", "rest", "fp"])

    keyed = fps.mapInArrow(run, "bits int, rest long, fp long")
    least = keyed.groupBy("bits", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(least, ["bits", "rest"]).where("fp > a").select("a", F.col("fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b): root is the component's smallest node.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller neighbours; both
    keep the components. It ends when a round changes nothing: then every node hangs on its root.
    """

    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    now = materialise(edges.select("a", "b").distinct(), "edges")
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(least(both), "u").where("v > u AND v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = down.join(least(down), "u")
        new = small.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        new = materialise(new, "edges")
        seen = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        discard(now)
        now = new
        if mark == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = seen


def grouped(prints: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) of every fingerprint of ``prints(doc_id, fp)``: its rows, its component's smallest fingerprint and smallest doc_id."""
    own = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    roots = components(links(own.select("fp"), own.count()))
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = roots.select("root").distinct()
    least = rooted.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root", "left").select("fp", "n", "root", F.coalesce("component_id", "least").alias("component_id"))


def link_documents(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every document."""
    prints = materialise(fingerprints(docs, k, seed), "prints")
    known = materialise(grouped(prints), "components")
    total = known.agg(F.sum("n")).first()[0] or 0
    return join_counted(prints, known.select("fp", "n", "component_id"), "fp", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """All columns as struct ``_row``, the doc_id as ``_id`` and the fingerprint as ``_fp``."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("simhash")
        for b in batches:
            values = np.array([fingerprint(t or b"", k, seed) for part in slices(b) for t in part.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_id"), pa.array(values.view(np.int64))], ["_row", "_id", "_fp"])

    schema = rows.drop("_text").withColumn("_fp", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, schema)


def deduplicate(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest doc_id stays (a null one only if there is no other).

    Of rows alike in doc_id and fingerprint, the one with the smallest hash of its columns stays.
    """
    prints = materialise(fingerprints(docs, k, seed), "prints")
    known = materialise(grouped(prints), "components")
    rows = prints.groupBy("doc_id", "fp").agg(F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "copies")).alias("s")
    stays = rows.join(known.select("fp", "root"), "fp").groupBy("root").agg(least).select("s.doc_id", "s.fp", "s.copies")
    stays = materialise(stays, "stays")
    kept = with_fingerprint(docs, k, seed).join(stays.select("doc_id", "fp"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_fp") == F.col("fp")), "left_semi")
    return one_of_each(kept, stays, "_fp").select("_row.*")


def one_of_each(kept: DataFrame, stays: DataFrame, name: str) -> DataFrame:
    """Of rows ``kept`` that are alike in ``_id`` and ``name``, the one with the smallest hash of its columns."""
    if not stays.where("copies > 1").limit(1).count():
        return kept
    return kept.groupBy("_id", name).agg(F.min_by("_row", F.struct(F.xxhash64(F.col("_row")), F.col("_row").cast("string"))).alias("_row"))
