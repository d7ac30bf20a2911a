"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

Each source's documents are dealt by hash to blocks. A target of words becomes a number of whole passes over the source and
a part of one more pass: whole blocks in permuted order, and of one boundary block the documents that come nearest to the rest
(of several permuted orders, the best). These block quotas are exact. A binary tree then splits them among output shards: at each node the left half's share of every
source is drawn from the multivariate hypergeometric distribution (conditional univariate draws by inversion, from hashes of
a seed), so the shards' mixes vary as if all blocks had been shuffled, without shuffling them. Each shard takes
its disjoint run of a source's permuted blocks and shuffles its rows locally.

Only aggregates are gathered: a row for each source, and for each block. All steps are Spark's own functions. All draws are
hashes of a seed and of row values, so reruns agree, however the rows are dealt.

Defined cases: a null text has size 0; a text of any length is counted whole; a null source is a source, last in order; sources without words have target 0; rows
alike in doc_id, size and source are taken together or not at all; an empty table gives no rows; extra columns are ignored
by ``plan_mix`` and kept by ``mix_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import BLANK, BLANKS, let
from .store import materialise

WEIGHTS, MOST, BLOCK_ROWS, SHARDS, SEED, TRIES = (5, 2, 1), 3, 128, 16, 20240607, 32
#: Plans of up to so many blocks, or sources, are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Blocks of a range of a source's permuted order; sources of a group; rows of a partition of the mix.
RANGE, GROUP, PARTITION_ROWS = 4096, 256, 100_000


def size_of(text: Column) -> Column:
    """Number of words: each, with the blanks before it, becomes one character."""
    bare = F.rtrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(bare, f"[{BLANK}]*+[^{BLANK}]++", "w")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the hash that stands for a row."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    return out.withColumn("key", row_key())


def row_key() -> Column:
    return F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("size"))


def targets(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """A row for each source: size, documents, target, whole passes and the words of one pass more.

    Where no source exceeds its bound the targets share all words by weight. Sources in the order of bound over weight
    are bounded one after another until the level that the others reach lies below the next one's bound.
    """
    own = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("ordinal", rank)
    own = own.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("ordinal") % len(weights) + 1).cast("int")))
    own = own.withColumn("bound", most * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    all_ = W.partitionBy()
    before = W.orderBy("ratio", "ordinal").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = own.withColumn("level", level)
    own = own.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "ordinal", "level"))).over(all_)["level"])
    own = own.withColumn("target", F.least(F.col("bound").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("bound").cast("double"))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    own = own.withColumn("passes", passes).withColumn("more", F.col("target") - F.col("passes") * F.col("source_size"))
    return own.withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_ROWS).cast("int")).select("source", "ordinal", "source_size", "n_docs", "target", "passes", "more", "n_blocks")


def _block() -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("key")), F.col("n_blocks")).cast("int")


def _joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """A left join to a plan table: broadcast if it is counted to be small, by a shuffle otherwise."""
    n = small.count()
    right = small.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in small.columns))
    right = F.broadcast(right) if n <= BROADCAST_ROWS else right
    condition = rows[on[0]].eqNullSafe(right[f"_{on[0]}"])
    for c in on[1:]:
        condition = condition & (rows[c] == right[f"_{c}"])
    return rows.join(right, condition, "left").drop(*(f"_{c}" for c in on))


def plan_mix(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The sources' table, and one row for each block that is taken at all beyond the whole passes.

    A block's row has its place in the permuted order of the partial pass and ``picked``: null if it is taken whole, else the keys of the rows to take.
    """
    sources = materialise(targets(slim, weights, most), "sources")
    rows = _joined(slim, sources.where("more > 0").select("source", "more", "n_blocks"), ["source"]).where("more IS NOT NULL").withColumn("block", _block())
    groups = rows.groupBy("source", "block", "key").agg(F.sum("size").alias("words"), F.first("more").alias("more"), F.first("n_blocks").alias("n_blocks"))
    sums = groups.groupBy("source", "block").agg(F.sum("words").alias("block_words"), F.first("more").alias("more"), F.first("n_blocks").alias("n_blocks"))
    sums = permuted(sums).withColumn("room", F.col("more") - F.col("before")).where("room > 0").drop("more", "before")
    sums = materialise(sums, "blocks")
    edge = sums.where("room < block_words").select(F.col("source").alias("_s"), F.col("block").alias("_b"), "room")
    inside = groups.join(edge, groups["source"].eqNullSafe(edge["_s"]) & (groups["block"] == edge["_b"]))
    listed = inside.groupBy("source", "block").agg(F.first("room").cast("double").alias("room"), F.collect_list(F.struct("key", "words")).alias("list"))
    picks = listed.select("source", "block", _fitting(F.col("list"), F.col("room")).alias("picked"))
    picks = materialise(picks, "picks")
    blocks = _joined(sums.select("source", "block", "place", "room", "block_words"), picks, ["source", "block"])
    blocks = materialise(blocks.select("source", "block", "place", "picked"), "plan")
    used = materialise(blocks.groupBy("source").agg(F.count("*").alias("part_blocks")), "used")
    quotas = materialise(_joined(sources, used, ["source"]).withColumn("quota", F.col("passes") * F.col("n_blocks") + F.coalesce("part_blocks", F.lit(0))), "quotas")
    tree = materialise(split_quotas(quotas.select("ordinal", "quota"), shards), "tree")
    sources = materialise(_joined(quotas.drop("part_blocks"), tree, ["ordinal"]), "shards")
    return sources, blocks


def permuted(sums: DataFrame) -> DataFrame:
    """Adds to the blocks of ``sums(source, block, block_words, n_blocks, ...)`` the ``place`` in the source's permuted order and the words ``before`` it.

    The order is by hash. It is cut in ranges of about ``RANGE`` blocks: a window over a source sees a row a range, and one over blocks only a range's.
    """
    at = F.xxhash64(F.lit(SEED + 2), "source", "block")
    ranges = F.ceil(F.col("n_blocks") / RANGE)
    sums = sums.withColumn("_at", at).withColumn("_range", F.least(F.floor((F.col("_at").cast("double") / float(1 << 64) + 0.5) * ranges), ranges - 1).cast("long")).drop("n_blocks")
    sums = materialise(sums, "permuted")
    earlier = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = sums.groupBy("source", "_range").agg(F.sum("block_words").alias("_words"), F.count("*").alias("_n"))
    totals = materialise(totals.select("source", "_range", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_words"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n")), "ranges")
    order = W.partitionBy("source", "_range").orderBy("_at", "block")
    out = _joined(sums, totals, ["source", "_range"]).withColumn("place", F.row_number().over(order) - 1 + F.col("_n"))
    return out.withColumn("before", F.sum("block_words").over(order) - F.col("block_words") + F.col("_words")).drop("_at", "_range", "_words", "_n")


def _fitting(rows: Column, room: Column) -> Column:
    """Keys of rows of a boundary block whose words come nearest to ``room``: of ``TRIES`` permuted orders, the best.

    In each order the rows that fit are taken one after another, and at the end one more if that comes nearer.
    """
    start = F.struct(room.alias("room"), F.array().cast("array<bigint>").alias("keys"))
    take = lambda s, x: F.struct((s["room"] - x["words"]).alias("room"), F.array_append(s["keys"], x["key"]).alias("keys"))

    def last(s: Column) -> Column:
        over = F.array_min(F.transform(F.filter(rows, lambda x: (x["words"] < 2 * s["room"]) & ~F.array_contains(s["keys"], x["key"])), lambda x: F.struct(F.abs(s["room"] - x["words"]).alias("far"), x["key"].alias("key"), x["words"].alias("words"))))
        return let(over, lambda o: F.when(o.isNull(), s).otherwise(take(s, o)))

    def attempt(j: Column) -> Column:
        order = F.sort_array(F.transform(rows, lambda x: F.struct(F.xxhash64(F.lit(SEED + 3), j, x["key"]).alias("at"), x["key"].alias("key"), x["words"].alias("words"))))
        done = F.aggregate(order, start, lambda s, x: F.when(x["words"] <= s["room"], take(s, x)).otherwise(s), last)
        return let(done, lambda s: F.struct(F.abs(s["room"]).alias("far"), j.alias("j"), s["keys"].alias("keys")))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), attempt))["keys"]


def _uniform(*of: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 4), *of), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(population: Column, successes: Column, draws: Column, u: Column) -> Column:
    """One draw by inversion of ``u``: successes among ``draws`` from ``population`` without replacement.

    The weights of the values are built up by their ratios from the lowest value that matters: those over twelve standard
    deviations from the mode have less weight than a double can tell.
    """
    x = let(F.struct(population.cast("double").alias("pop"), successes.cast("double").alias("hits"), draws.cast("double").alias("take"), u.alias("u")), lambda p: _invert(p))
    return x.cast("long")


def _invert(p: Column) -> Column:
    N, K, n = p["pop"], p["hits"], p["take"]
    low, high = F.greatest(F.lit(0.0), n - (N - K)), F.least(K, n)
    mode = F.least(F.greatest(F.floor((n + 1) * (K + 1) / (N + 2)), low), high)
    wide = F.ceil(12 * F.sqrt(n * K / N * (1 - K / N) * (N - n) / F.greatest(N - 1, F.lit(1.0)))) + 12
    span = F.struct(F.greatest(low, mode - wide).cast("long").alias("a"), F.least(high, mode + wide).cast("long").alias("b"))

    def ratio(x: Column) -> Column:
        return (K - x) * (n - x) / ((x + 1) * (N - K - n + x + 1))

    def body(s: Column) -> Column:
        steps = F.when(s["b"] > s["a"], F.sequence(s["a"], s["b"] - 1)).otherwise(F.array().cast("array<bigint>"))
        total = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t")), lambda c, x: let(c["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (c["t"] + w).alias("t"))), lambda c: c["t"])

        def find(t: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t"), s["a"].alias("x"))
            move = lambda c, x: F.when(c["t"] >= p["u"] * t, c).otherwise(let(c["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (c["t"] + w).alias("t"), (x + 1).alias("x"))))
            return F.aggregate(steps, begin, move, lambda c: c["x"])

        return let(total, find)

    return F.when((n <= 0) | (K <= 0), F.lit(0).cast("long")).otherwise(let(span, body))


def split_quotas(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(ordinal, ends): for each source, where each shard's run of its blocks ends; shards is a power of two.

    Sources are drawn for in groups of ``GROUP``: first each group's share of the left half, then each source's share of its group's.
    That is the same distribution, and no row holds more than a group's sources or all groups' totals.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    own = quotas.select(F.floor(F.col("ordinal") / GROUP).cast("long").alias("grp"), (F.col("ordinal") % GROUP).alias("i"), F.col("quota").cast("long").alias("quota"))
    own = materialise(own.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "quota"))), lambda x: x["quota"]).alias("q")), "quota-groups")
    groups = own.count()
    nodes = own.select(F.lit(0).alias("node"), "grp", "q")
    total = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)

    def drawn(q: Column, take: Column, *seeds: Column) -> Column:
        """Of each entry of ``q`` the share of ``take`` draws from all, by conditional draws."""
        start = F.struct(total(q).alias("pop"), take.alias("take"), F.array().cast("array<bigint>").alias("got"))

        def draw(s: Column, K: Column) -> Column:
            u = _uniform(*seeds, F.array_size(s["got"]))
            return let(hypergeometric(s["pop"], K, s["take"], u), lambda x: F.struct((s["pop"] - K).alias("pop"), (s["take"] - x).alias("take"), F.array_append(s["got"], x).alias("got")))

        return F.aggregate(q, start, draw, lambda s: s["got"])

    half = lambda q: F.floor(total(q) / 2).cast("long")
    width = shards
    while width > 1:
        if groups > 1:
            totals = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("grp", total(F.col("q")).alias("t")))).alias("g"))
            totals = totals.select("node", "g", F.transform("g", lambda x: x["t"]).alias("t"))
            shares = totals.select("node", F.explode(F.zip_with("g", drawn(F.col("t"), half(F.col("t")), F.lit(-width), F.col("node")), lambda g, n: F.struct(g["grp"].alias("grp"), n.alias("take")))).alias("x"))
            nodes = nodes.join(shares.select("node", "x.grp", "x.take"), ["node", "grp"])
        else:
            nodes = nodes.withColumn("take", half(F.col("q")))
        left = nodes.select("node", "grp", "q", drawn(F.col("q"), F.col("take"), F.lit(width), F.col("node"), F.col("grp")).alias("l"))
        halves = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("l").alias("q")), F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("q", "l", lambda a, b: a - b).alias("q")))
        nodes = left.select("grp", F.explode(halves).alias("h")).select("h.node", "grp", "h.q")
        if groups > 1:
            nodes = materialise(nodes, "tree-level")
        width //= 2
    flat = nodes.select("node", "grp", F.posexplode("q").alias("i", "n")).select("node", (F.col("grp") * GROUP + F.col("i")).cast("int").alias("ordinal"), "n")
    ends = F.sum("n").over(W.partitionBy("ordinal").orderBy("node"))
    return flat.withColumn("end", ends).groupBy("ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def apply_mix(rows: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds source_size, target and ``shards`` (the shard of each copy that is taken) to rows with doc_id, source, size and key."""
    out = _joined(rows, sources.select("source", "source_size", "target", "passes", "n_blocks", "ends"), ["source"]).withColumn("block", _block())
    out = _joined(out, blocks, ["source", "block"])
    more = F.col("place").isNotNull() & (F.col("picked").isNull() | F.array_contains("picked", F.col("key")))
    # Whole passes come first in a source's run of blocks, each in an order of its own: the block's number shifted by a hash.
    shift = lambda i: F.pmod(F.col("block") + F.pmod(F.xxhash64(F.lit(SEED + 5), F.col("source"), i), F.col("n_blocks")), F.col("n_blocks"))
    slots = F.transform(F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i * F.col("n_blocks") + shift(i)).cast("long"))
    slots = F.concat(slots, F.when(more, F.array((F.col("passes") * F.col("n_blocks") + F.col("place")).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    shard = F.transform(slots, lambda s: F.array_size(F.filter("ends", lambda e: e <= s)))
    return out.withColumn("shards", shard).drop("passes", "n_blocks", "ends", "block", "place", "picked")


def mix_counts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards of the copies, for every document."""
    slim = materialise(sized(docs), "sized")
    out = apply_mix(slim, *plan_mix(slim, weights, most, shards))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.array_size("shards")).alias("taken"), "shards")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: a row for each copy of a document, dealt to the shards and shuffled in each."""
    slim = materialise(sized(docs), "sized")
    sources, blocks = plan_mix(slim, weights, most, shards)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    copies = apply_mix(rows.withColumn("key", row_key()), sources, blocks).select("_row", "key", F.posexplode("shards").alias("_copy", "_shard"))
    drawn = copies.withColumn("_order", F.xxhash64(F.lit(seed), "key", "_copy"))
    # A shard may be large: its rows go to as many partitions, by their order, as its documents ask for.
    parts = max(64, math.ceil(MOST * (sources.agg(F.sum("n_docs")).first()[0] or 0) / (shards * PARTITION_ROWS)))
    keys = (F.col("_shard"), F.pmod("_order", F.lit(parts)))
    dealt = drawn.repartition(shards * parts, *keys) if parts > 64 else drawn.repartition(*keys)
    return dealt.sortWithinPartitions("_shard", "_order").select("_row.*")
