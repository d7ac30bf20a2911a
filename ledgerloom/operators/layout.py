"""Words, rows, columns, cells and rules of pages, by windows within a page and joins on it.

Words are rows of doc_id, page, ix, text, x0, y0, x1, y1. Joins are equi-joins on the page with a condition on places; all windows are over one page or row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import area, box, common, holds_centre
from ..functions.text import anchor_token, upper_key

PAGE = ["doc_id", "page"]


def distinct_words(words: DataFrame) -> DataFrame:
    """The first of words that stand in one place (to a hundredth) with one text: doubled layers of a page."""
    place = [F.round(c, 2) for c in ("x0", "y0", "x1", "y1")]
    return words.withColumn("_n", F.row_number().over(W.partitionBy(*PAGE, "text", *place).orderBy("ix"))).where("_n = 1").drop("_n")


def stitched(words: DataFrame) -> DataFrame:
    """Touching fragments of an identifier in a row (words also have ``row``) as one word, where a separator stands at the joint and a digit is in it."""
    order = W.partitionBy(*PAGE, "row").orderBy("x0", "ix")
    piece = F.col("text").rlike("^[A-Za-z0-9./_-]+$")
    before = lambda c: F.lag(c).over(order)
    height = F.least(F.col("y1") - F.col("y0"), before("y1") - before("y0"))
    level = F.abs(F.col("y0") + F.col("y1") - before("y0") - before("y1")) <= height * 0.20
    joint = before("text").rlike("[./_-]$") | F.col("text").rlike("^[./_-]")
    joined = piece & before("text").rlike("^[A-Za-z0-9./_-]+$") & (height > 0) & level & joint & (F.abs(F.col("x0") - before("x1")) <= 0.10)
    rows = words.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    runs = rows.withColumn("_digit", F.max(F.col("text").rlike("[0-9]").cast("int")).over(W.partitionBy(*PAGE, "row", "_run")))
    runs = runs.withColumn("_run", F.when(F.col("_digit") == 1, F.concat(F.lit("r"), F.col("_run").cast("string"))).otherwise(F.concat(F.lit("w"), F.col("ix").cast("string"))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ix", "text"))), lambda w: w["text"]), "")
    return runs.groupBy(*PAGE, "row", "_run").agg(F.min("ix").alias("ix"), text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("_run")


def row_texts(words: DataFrame) -> DataFrame:
    """A row for each visual row: its words from left to right, its box and mean confidence (words also have ``row`` and ``confidence``)."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ix", "text"))), lambda w: w["text"]), " ")
    return words.groupBy(*PAGE, "row").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.avg("confidence"), 9).alias("confidence"))


def page_signs(words: DataFrame, sizes: DataFrame, least_words: int = 8, least_characters: int = 30, least_cover: float = 0.002) -> DataFrame:
    """(doc_id, page, is_native, garbled, rotated) of pages (doc_id, page, width, height): enough words to be read as they are, a text layer of private signs, words that are taller than wide."""
    private = F.length(F.regexp_replace("text", r"[^\x{E000}-\x{F8FF}]", ""))
    tall = (F.col("y1") - F.col("y0")) > 1.4 * (F.col("x1") - F.col("x0"))
    eligible = F.length("text") >= 3
    per = words.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.sum(area(box())).alias("a"), F.sum(private).alias("p"), F.count_if(eligible).alias("e"), F.count_if(eligible & tall).alias("t"))
    rows = sizes.join(per, PAGE, "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    native = (z("n") >= least_words) & (z("c") >= least_characters) & (z("a") / (F.col("width") * F.col("height")) >= least_cover)
    return rows.select(*PAGE, native.alias("is_native"), ((z("c") >= 100) & (z("p") >= 0.35 * z("c"))).alias("garbled"), ((z("e") >= 20) & (z("t") >= 0.8 * z("e"))).alias("rotated"))


def supplemented(native: DataFrame, read: DataFrame, share: float = 0.25) -> DataFrame:
    """Native words and those read from the image that overlap no native one by more than a share of their own area."""
    n = native.select(*PAGE, *(F.col(c).alias(f"n_{c}") for c in ("x0", "y0", "x1", "y1")))
    own, other = box(), box("n_")
    covered = (F.least(own[2], other[2]) > F.greatest(own[0], other[0])) & (common(own, other) > share * area(own))
    kept = read.alias("r").join(n.alias("n"), (F.col("r.doc_id") == F.col("n.doc_id")) & (F.col("r.page") == F.col("n.page")) & covered, "left_anti")
    return native.unionByName(kept)


def region_texts(words: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, region, text): the words whose centres lie in each region (region, r_x0 to r_y1), row by row. Words also have ``row``."""
    inside = words.join(regions, PAGE).where(holds_centre(box("r_"), box(), 0.0))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "x0", "ix", "text"))), lambda w: w["text"]), " ")
    return regions.select(*PAGE, "region").join(inside.groupBy(*PAGE, "region").agg(text.alias("text")), [*PAGE, "region"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def segments(words: DataFrame, gap: float = 60.0, rules: DataFrame | None = None, rectangles: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, row, segment, text, x0, x1, boundary): rows cut at wide gaps, and at vertical rules or between rectangles where these are given.

    ``rules`` has doc_id, page, x, y0, y1; ``rectangles`` rect, r_x0 to r_y1. A word lies in the smallest rectangle that holds its centre.
    """
    order = W.partitionBy(*PAGE, "row").orderBy("x0", "ix")
    rows = words.withColumns({"_px": F.lag("x1").over(order), "_py0": F.lag("y0").over(order), "_py1": F.lag("y1").over(order)})
    drawn = F.lit(False)
    if rules is not None:
        r = rules.select(*PAGE, F.col("x").alias("_rx"), F.col("y0").alias("_ry0"), F.col("y1").alias("_ry1"))
        between = F.col("_rx").between(F.col("_px") - 1.0, F.col("x0") + 1.0) & (F.col("_ry0") <= F.least("_py0", "y0") + 1.5) & (F.col("_ry1") >= F.greatest("_py1", "y1") - 1.5)
        cut = rows.where("_px IS NOT NULL").join(r, PAGE).where(between).select(*PAGE, "ix").distinct().withColumn("_rule", F.lit(True))
        rows = rows.join(cut, [*PAGE, "ix"], "left")
        drawn = drawn | F.coalesce("_rule", F.lit(False))
    if rectangles is not None:
        placed = smallest_holder(words, rectangles).select(*PAGE, "ix", F.col("rect").alias("_rect"))
        rows = rows.join(placed, [*PAGE, "ix"], "left").withColumn("_prect", F.lag("_rect").over(order))
        drawn = drawn | F.coalesce(F.col("_rect") != F.col("_prect"), F.lit(False))
    wide = F.coalesce(F.col("x0") - F.col("_px") > gap, F.lit(False))
    rows = rows.withColumn("_why", F.when(F.col("_px").isNotNull(), F.when(drawn, "rule").when(wide, "gap"))).withColumn("segment", F.sum(F.col("_why").isNotNull().cast("int")).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ix", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy(*PAGE, "row", "segment").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min_by("_why", F.struct("x0", "ix")).alias("boundary"))


def smallest_holder(words: DataFrame, rectangles: DataFrame, margin: float = 1.0) -> DataFrame:
    """Words with the smallest rectangle (rect, r_x0 to r_y1) of their page that holds their centre; words in none are left out."""
    pairs = words.join(rectangles, PAGE).where(holds_centre(box("r_"), box(), margin))
    least = F.min(F.struct(area(box("r_")).alias("a"), "rect")).alias("m")
    return words.join(pairs.groupBy(*PAGE, "ix").agg(least), [*PAGE, "ix"]).withColumn("rect", F.col("m.rect")).drop("m")


def labels_of(words: DataFrame, regions: DataFrame, outside: str = "O") -> DataFrame:
    """(doc_id, page, ix, label, conflict): the label of the smallest region (label, r_x0 to r_y1) that holds each word's centre; regions of one size with several labels conflict."""
    pairs = words.select(*PAGE, "ix", "x0", "y0", "x1", "y1").join(regions, PAGE).where(holds_centre(box("r_"), box(), 0.0)).select(*PAGE, "ix", F.round(area(box("r_")), 6).alias("a"), "label")
    per = pairs.groupBy(*PAGE, "ix", "a").agg(F.min("label").alias("label"), F.count_distinct("label").alias("n"))
    best = per.groupBy(*PAGE, "ix").agg(F.min(F.struct("a", "label", "n")).alias("m"))
    rows = words.select(*PAGE, "ix").join(best, [*PAGE, "ix"], "left")
    return rows.select(*PAGE, "ix", F.coalesce("m.label", F.lit(outside)).alias("label"), F.coalesce(F.col("m.n") > 1, F.lit(False)).alias("conflict"))


def merged_rules(rules: DataFrame, tolerance: float = 1.4) -> DataFrame:
    """(doc_id, page, orientation, at, low, high): pieces of rules on one line that touch, as one. Rules have orientation, at, low, high.

    Lines are runs of places no further apart than the tolerance; on a line, pieces that reach the furthest end so far are one.
    """
    line = W.partitionBy(*PAGE, "orientation").orderBy("at", "low", "high")
    rows = rules.withColumn("_line", F.sum(F.coalesce((F.col("at") - F.lag("at").over(line) > tolerance).cast("int"), F.lit(0))).over(line))
    along = W.partitionBy(*PAGE, "orientation", "_line").orderBy("low", "high")
    reach = F.max("high").over(along.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("low") > reach + tolerance).cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(along))
    return rows.groupBy(*PAGE, "orientation", "_line", "_run").agg(F.round(F.avg("at"), 3).alias("at"), F.min("low").alias("low"), F.max("high").alias("high")).drop("_line", "_run")


def separators(rules: DataFrame, zones: DataFrame, share: float = 0.45, near: float = 4.0) -> DataFrame:
    """(doc_id, page, zone, x): vertical rules that cover a share of a zone's height (zone, z_x0 to z_y1), those close together once."""
    rows = rules.where("orientation = 'vertical'").join(zones, PAGE)
    covered = F.least("high", "z_y1") - F.greatest("low", "z_y0")
    rows = rows.where(F.col("at").between(F.col("z_x0"), F.col("z_x1")) & (covered >= share * (F.col("z_y1") - F.col("z_y0"))))
    new = F.coalesce(F.col("at") - F.lag("at").over(W.partitionBy(*PAGE, "zone").orderBy("at")) > near, F.lit(True))
    return rows.withColumn("_new", new).where("_new").select(*PAGE, "zone", F.col("at").alias("x"))


def column_regions(rules: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, page, column, low, high): the neighbouring rules around each header's centre (column, x, top, bottom), if every column of a page has bounds of its own."""
    r = rules.where("orientation = 'vertical'").join(headers.groupBy(*PAGE).agg(F.min("top").alias("_t"), F.max("bottom").alias("_b")), PAGE).where("low <= _t + 2 AND high >= _b - 2").select(*PAGE, "at").distinct()
    pairs = headers.join(r, PAGE)
    bounds = pairs.groupBy(*PAGE, "column", "x").agg(F.max(F.when(F.col("at") < F.col("x"), F.col("at"))).alias("low"), F.min(F.when(F.col("at") > F.col("x"), F.col("at"))).alias("high"))
    alone = bounds.withColumns({"_n": F.count("*").over(W.partitionBy(*PAGE, "low", "high"))}).where("low IS NOT NULL AND high IS NOT NULL AND _n = 1")
    whole = headers.groupBy(*PAGE).agg(F.count_distinct("column").alias("_want")).join(alone.groupBy(*PAGE).agg(F.count("*").alias("_have")), PAGE).where("_want = _have").select(*PAGE)
    return alone.join(whole, PAGE).select(*PAGE, "column", "low", "high")


def columns_of(words: DataFrame, headers: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, row, column, text): each word of a row in the column whose region holds its centre, or without regions in that of the nearest header (column, x), ties to the first."""
    centre = (F.col("x0") + F.col("x1")) / 2
    if regions is not None:
        placed = words.join(regions, PAGE).where((centre >= F.col("low")) & (centre < F.col("high")))
    else:
        pairs = words.join(headers.select(*PAGE, "column", "x"), PAGE).withColumn("_far", F.abs(centre - F.col("x")))
        best = pairs.groupBy(*PAGE, "ix").agg(F.min(F.struct("_far", "x", "column"))["column"].alias("column"))
        placed = words.join(best, [*PAGE, "ix"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ix", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*PAGE, "row", "column").agg(text.alias("text"))


def nearest(items: DataFrame, points: DataFrame, side: str | None = None, most: float = 180.0) -> DataFrame:
    """(doc_id, page, point, ix, distance): the item nearest to each point (point, x), only left or right of it if asked, no further than ``most``; ties to the first."""
    centre = (F.col("x0") + F.col("x1")) / 2
    pairs = items.join(points, PAGE).withColumn("distance", F.abs(centre - F.col("x"))).where(F.col("distance") <= most)
    pairs = pairs.where(F.col("x1") <= F.col("x")) if side == "left" else pairs.where(F.col("x0") >= F.col("x")) if side == "right" else pairs
    return pairs.groupBy(*PAGE, "point").agg(F.min(F.struct("distance", "ix")).alias("m")).select(*PAGE, "point", "m.ix", "m.distance")


def numbers_below(words: DataFrame, anchors: DataFrame, rows: int = 3, most: float = 110.0) -> DataFrame:
    """(doc_id, page, anchor, ix): the nearest number in the rows below each anchor (anchor, a_row, x), the higher row first."""
    numeric = words.where(F.col("text").rlike("^[0-9][0-9 .,]*[0-9]$|^[0-9]$"))
    pairs = numeric.join(anchors, PAGE).where(F.col("row").between(F.col("a_row") + 1, F.col("a_row") + rows)).withColumn("_far", F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("x"))).where(F.col("_far") < most)
    return pairs.groupBy(*PAGE, "anchor").agg(F.min(F.struct("row", "_far", "ix"))["ix"].alias("ix"))


def value_places(words: DataFrame, values: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, page, row, value, first, last): where a value (doc_id, value) is printed: up to ``most`` words in a row whose letters and digits together are the value's.

    Each word's runs are built as prefixes of its row, and met with the values by equality of the key, so no word meets a value that it doesn't begin.
    """
    order = W.partitionBy(*PAGE, "row").orderBy("x0", "ix")
    ahead = F.collect_list(F.struct("ix", upper_key(F.col("text")).alias("k"))).over(order.rowsBetween(0, most - 1))
    rows = words.select(*PAGE, "row", "ix", ahead.alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.array_size("w")), lambda n: F.struct(F.array_join(F.transform(F.slice("w", F.lit(1), n), lambda x: x["k"]), "").alias("key"), F.element_at("w", n)["ix"].alias("last")))
    found = rows.select(*PAGE, "row", F.col("ix").alias("first"), F.explode(runs).alias("r")).select(*PAGE, "row", "first", "r.key", "r.last").where("key <> ''")
    return found.join(values.select("doc_id", "value", upper_key(F.col("value")).alias("key")), ["doc_id", "key"]).select(*PAGE, "row", "value", "first", "last")


def page_anchors(source: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, page, token, dx, dy): words that stand once on both pages, and how far they moved."""
    one = lambda w, s: w.select(*PAGE, anchor_token(F.col("text")).alias("token"), ((F.col("x0") + F.col("x1")) / 2).alias(f"x{s}"), ((F.col("y0") + F.col("y1")) / 2).alias(f"y{s}")).where("token <> ''").groupBy(*PAGE, "token").agg(F.count("*").alias("n"), F.min(f"x{s}").alias(f"x{s}"), F.min(f"y{s}").alias(f"y{s}")).where("n = 1").drop("n")
    return one(source, "a").join(one(target, "b"), [*PAGE, "token"]).select(*PAGE, "token", F.round(F.col("xb") - F.col("xa"), 3).alias("dx"), F.round(F.col("yb") - F.col("ya"), 3).alias("dy"))


def unions(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all boxes of each key, and how many they are."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def merged_labels(words: DataFrame, gap: float = 40.0) -> DataFrame:
    """(doc_id, page, row, label, text, x0, x1, confidence): neighbouring words of a row with one label, no further apart than ``gap``, as one; words without a label go. Words also have row, label, confidence."""
    order = W.partitionBy(*PAGE, "row").orderBy("x0", "ix")
    new = (F.col("label") != F.lag("label").over(order)) | (F.col("x0") - F.lag("x1").over(order) > gap)
    rows = words.withColumn("_run", F.sum(F.coalesce(new.cast("int"), F.lit(1))).over(order)).where("label <> 'O'")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ix", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy(*PAGE, "row", "_run", "label").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.round(F.avg("confidence"), 9).alias("confidence")).drop("_run")


def token_contexts(words: DataFrame, reach: int = 2) -> DataFrame:
    """(doc_id, page, ix, context): each word in lower case with those before and after it in its row, named by their distance."""
    from ..functions.identifiers import character_shape

    order = W.partitionBy(*PAGE, "row").orderBy("x0", "ix")
    parts = [F.concat(F.lit("w="), F.lower("text")), F.concat(F.lit("s="), character_shape(F.col("text")))]
    for d in range(1, reach + 1):
        parts += [F.concat(F.lit(f"p{d}="), F.lower(F.lag("text", d).over(order))), F.concat(F.lit(f"n{d}="), F.lower(F.lead("text", d).over(order)))]
    return words.select(*PAGE, "ix", F.concat_ws(" ", *parts).alias("context"))
