"""Queries of layout: every order is a page, every line of it a row of four words; the places tell what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import spatial
from .registry import query, table

_IX = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT)"
_ROW = ["l_orderkey AS doc_id", f"{_IX} AS row", "l_partkey AS k", "l_suppkey AS s", "l_quantity AS q"]
_ROWS = f"SELECT {', '.join(_ROW)} FROM lineitem"


def words(spark, sf):
    """Reference at 20 to 80, name at 120 to 180, quantity at 220 to 280, price at 400 to 460; rows 20 apart, a little askew."""
    rows = table(spark, sf, "lineitem").selectExpr(*_ROW)
    texts = F.array(F.concat(F.lit("R"), F.col("k").cast("string")), F.concat(F.lit("Été"), F.col("s").cast("string")), F.col("q").cast("int").cast("string"), F.concat((F.col("k") % 100).cast("string"), F.lit(",50")))
    lefts = F.array(*map(F.lit, (20.0, 120.0, 220.0, 400.0)))
    w = rows.select("*", F.posexplode(texts).alias("c", "text")).withColumns({"page": F.lit(1), "ix": F.col("row") * 4 + F.col("c"), "x0": F.element_at(lefts, F.col("c") + 1), "y0": F.col("row") * 20.0 + F.col("c") * 0.5})
    return w.withColumns({"x1": F.col("x0") + 60.0, "y1": F.col("y0") + 10.0, "confidence": 0.9 + F.col("c") * 0.01})


_W = f"SELECT doc_id, row, k, s, q, c, 1 AS page, row * 4 + c AS ix, CASE c WHEN 0 THEN 'R' || k WHEN 1 THEN 'Été' || s WHEN 2 THEN CAST(CAST(q AS INT) AS VARCHAR) ELSE (k % 100) || ',50' END AS text, [20.0, 120.0, 220.0, 400.0][c + 1]::DOUBLE AS x0, row * 20.0::DOUBLE + c * 0.5 AS y0 FROM ({_ROWS}), (SELECT unnest([0, 1, 2, 3]) AS c)"


@query(f"SELECT doc_id, ix, row - 1 AS row FROM ({_W})")
def row_clustering(spark, sf):
    """Words without their rows, in rows again."""
    w = words(spark, sf).select("doc_id", "page", "ix", "text", "x0", "y0", "x1", "y1")
    return spatial.rows_of_words(w).select("doc_id", "ix", "row")


@query(f"SELECT doc_id, row, string_agg(text, ' ' ORDER BY x0) AS text, 20.0::DOUBLE AS x0, 460.0::DOUBLE AS x1, min(y0) AS y0, 0.915::DOUBLE AS confidence FROM ({_W}) GROUP BY ALL")
def visual_row_texts(spark, sf):
    return L.row_texts(words(spark, sf)).select("doc_id", "row", "text", "x0", "x1", "y0", "confidence")


@query(f"SELECT doc_id, ix, text FROM ({_W})")
def doubled_words(spark, sf):
    w = words(spark, sf)
    again = w.where("k % 3 = 0").withColumns({"ix": F.col("ix") + 1000, "x0": F.col("x0") + 0.001})
    return L.distinct_words(w.unionByName(again)).select("doc_id", "ix", "text")


@query(f"SELECT doc_id, row, 'R' || k || '/' || s AS text FROM ({_ROWS}) UNION ALL SELECT doc_id, row, 'x' FROM ({_ROWS}) UNION ALL SELECT doc_id, row, 'a/' FROM ({_ROWS}) UNION ALL SELECT doc_id, row, 'b' FROM ({_ROWS})")
def stitched_identifiers(spark, sf):
    """``R12/`` and ``34`` touch and are one; ``a/`` and ``b`` touch without a digit; ``x`` stands apart."""
    rows = table(spark, sf, "lineitem").selectExpr(*_ROW)
    parts = F.array(*(F.struct(t.alias("text"), F.lit(x).alias("x0"), F.lit(x + 30.0).alias("x1")) for t, x in ((F.concat(F.lit("R"), F.col("k").cast("string"), F.lit("/")), 0.0), (F.col("s").cast("string"), 30.05), (F.lit("x"), 70.0), (F.lit("a/"), 120.0), (F.lit("b"), 150.0))))
    w = rows.select("doc_id", "row", F.posexplode(parts).alias("ix", "w")).select("doc_id", "row", "ix", "w.*").withColumns({"page": F.lit(1), "y0": F.col("row") * 20.0, "y1": F.col("row") * 20.0 + 10})
    return L.stitched(w).select("doc_id", "row", "text")


@query(f"SELECT doc_id, count(*) >= 8 AND sum(length(text)) >= 30 AND count(*) * 600 / (500.0 * (300 + doc_id % 7 * 400000)) >= 0.002 AS is_native, false AS garbled, false AS rotated FROM ({_W}) GROUP BY doc_id")
def page_signs(spark, sf):
    w = words(spark, sf)
    sizes = w.select("doc_id", "page").distinct().withColumns({"width": F.lit(500.0), "height": 300.0 + F.col("doc_id") % 7 * 400000})
    return L.page_signs(w, sizes).drop("page")


@query(f"SELECT doc_id, ix FROM ({_W}) UNION ALL SELECT doc_id, ix + 1000 FROM ({_W}) WHERE k % 2 = 0")
def supplemented_words(spark, sf):
    """Read words that are moved by 40 overlap a third of a native one; those moved by 50 a sixth."""
    w = words(spark, sf).select("doc_id", "page", "ix", "k", "text", "x0", "y0", "x1", "y1")
    shift = F.when(F.col("k") % 2 == 0, 50.0).otherwise(40.0)
    read = w.withColumns({"ix": F.col("ix") + 1000, "x0": F.col("x0") + shift, "x1": F.col("x1") + shift})
    return L.supplemented(w, read).select("doc_id", "ix")


@query(f"SELECT doc_id, coalesce(string_agg(text, ' ' ORDER BY row, x0) FILTER (c BETWEEN 1 AND 2 AND row <= 2), '') AS text FROM ({_W}) GROUP BY doc_id")
def region_texts(spark, sf):
    w = words(spark, sf)
    region = w.select("doc_id", "page").distinct().withColumns({"region": F.lit(0), "r_x0": F.lit(100.0), "r_y0": F.lit(0.0), "r_x1": F.lit(300.0), "r_y1": F.lit(55.0)})
    return L.region_texts(w, region).select("doc_id", "text")


@query(f"SELECT doc_id, row, 0 AS segment, string_agg(text, ' ' ORDER BY x0) AS text, CAST(NULL AS VARCHAR) AS boundary FROM ({_W}) WHERE c < 3 GROUP BY doc_id, row UNION ALL SELECT doc_id, row, 1, text, 'gap' FROM ({_W}) WHERE c = 3")
def row_segments(spark, sf):
    return L.segments(words(spark, sf)).select("doc_id", "row", F.col("segment").cast("int").alias("segment"), "text", "boundary")


@query(f"SELECT doc_id, row, CASE WHEN doc_id % 2 = 0 THEN CASE c WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END ELSE CASE c WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END END AS segment, string_agg(text, ' ' ORDER BY x0) AS text, min(CASE WHEN c = 3 THEN 'gap' WHEN doc_id % 2 = 0 AND c = 1 THEN 'rule' WHEN doc_id % 2 = 1 AND c = 2 THEN 'rule' END) AS boundary FROM ({_W}) GROUP BY ALL")
def compartments(spark, sf):
    """Even pages have a rule between the first two words, odd ones rectangles around the first two and the third."""
    w = words(spark, sf)
    pages = w.select("doc_id", "page").distinct()
    rules = pages.where("doc_id % 2 = 0").withColumns({"x": F.lit(100.0), "y0": F.lit(0.0), "y1": F.lit(900.0)})
    rect = lambda n, a, b: F.struct(F.lit(n).alias("rect"), F.lit(a).alias("r_x0"), F.lit(0.0).alias("r_y0"), F.lit(b).alias("r_x1"), F.lit(900.0).alias("r_y1"))
    rectangles = pages.where("doc_id % 2 = 1").select("doc_id", "page", F.explode(F.array(rect(0, 0.0, 300.0), rect(1, 10.0, 190.0), rect(2, 210.0, 290.0))).alias("r")).select("doc_id", "page", "r.*")
    return L.segments(w, 60.0, rules, rectangles).select("doc_id", "row", F.col("segment").cast("int").alias("segment"), "text", "boundary")


@query(f"SELECT doc_id, ix, CASE WHEN c = 2 THEN 'QTY' WHEN c < 2 AND row <= 2 THEN 'HEAD' ELSE 'O' END AS label, c = 2 AND doc_id % 5 = 0 AS conflict FROM ({_W})")
def region_labels(spark, sf):
    w = words(spark, sf)
    pages = w.select("doc_id", "page").distinct()
    region = lambda label, a, b, c, d: F.struct(F.lit(label).alias("label"), F.lit(a).alias("r_x0"), F.lit(b).alias("r_y0"), F.lit(c).alias("r_x1"), F.lit(d).alias("r_y1"))
    same = F.when(F.col("doc_id") % 5 == 0, region("X", 210.0, 0.0, 290.0, 900.0))
    regions = pages.select("doc_id", "page", F.explode(F.array_compact(F.array(region("HEAD", 0.0, 0.0, 190.0, 55.0), region("QTY", 210.0, 0.0, 290.0, 900.0), same))).alias("r")).select("doc_id", "page", "r.*")
    return L.labels_of(w, regions).select("doc_id", "ix", "label", "conflict")


@query(f"SELECT doc_id, 'vertical' AS orientation, 100.5::DOUBLE AS at, 20.0::DOUBLE AS low, max(row) * 20.0 + 21 AS high FROM ({_ROWS}) GROUP BY 1 UNION ALL SELECT doc_id, 'vertical', 300.0::DOUBLE, row * 20.0::DOUBLE, row * 20.0 + 10 FROM ({_ROWS})")
def merged_rules(spark, sf):
    """Pieces at 100 and 101 that touch from row to row are one rule; those at 300 lie ten apart."""
    rows = table(spark, sf, "lineitem").selectExpr(*_ROW).withColumn("page", F.lit(1))
    piece = lambda at, more: F.struct(F.lit("vertical").alias("orientation"), F.lit(at).alias("at"), (F.col("row") * 20.0).alias("low"), (F.col("row") * 20.0 + more).alias("high"))
    rules = rows.select("doc_id", "page", F.explode(F.array(piece(100.0, 19.5), piece(101.0, 21.0), piece(300.0, 10.0))).alias("r")).select("doc_id", "page", "r.*")
    return L.merged_rules(rules).drop("page")


@query(f"SELECT doc_id, unnest([60.0::DOUBLE, 200.0::DOUBLE]) AS x FROM ({_ROWS}) GROUP BY doc_id")
def vector_separators(spark, sf):
    pages = words(spark, sf).select("doc_id", "page").distinct()
    rule = lambda at, low, high: F.struct(F.lit("vertical").alias("orientation"), F.lit(at).alias("at"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    rules = pages.select("doc_id", "page", F.explode(F.array(rule(60.0, 0.0, 50.0), rule(62.0, 0.0, 99.0), rule(120.0, 0.0, 40.0), rule(200.0, 50.0, 100.0), rule(900.0, 0.0, 100.0))).alias("r")).select("doc_id", "page", "r.*")
    zones = pages.withColumns({"zone": F.lit(0), "z_x0": F.lit(0.0), "z_y0": F.lit(0.0), "z_x1": F.lit(300.0), "z_y1": F.lit(100.0)})
    return L.separators(rules, zones).select("doc_id", "x")


def _headers(spark, sf):
    pages = words(spark, sf).select("doc_id", "page").distinct()
    head = lambda name, x: F.struct(F.lit(name).alias("column"), F.lit(x).alias("x"), F.lit(0.0).alias("top"), F.lit(10.0).alias("bottom"))
    return pages.select("doc_id", "page", F.explode(F.array(head("ref", 40.0), head("name", 160.0), head("rest", 330.0))).alias("h")).select("doc_id", "page", "h.*")


@query(f"SELECT doc_id, row, CASE c WHEN 0 THEN 'ref' WHEN 1 THEN 'name' ELSE 'rest' END AS column, string_agg(text, ' ' ORDER BY x0) AS text FROM ({_W}) GROUP BY ALL")
def nearest_columns(spark, sf):
    return L.columns_of(words(spark, sf), _headers(spark, sf)).select("doc_id", "row", "column", "text")


@query(f"SELECT doc_id, row, CASE c WHEN 0 THEN 'ref' WHEN 3 THEN 'rest' ELSE 'name' END AS column, string_agg(text, ' ' ORDER BY x0) AS text FROM ({_W}) WHERE doc_id % 2 = 0 GROUP BY ALL")
def ruled_columns(spark, sf):
    """Even pages have a rule around every column; odd ones lack one, so that their columns have no bounds."""
    headers = _headers(spark, sf)
    rule = lambda at: F.struct(F.lit("vertical").alias("orientation"), F.lit(at).alias("at"), F.lit(0.0).alias("low"), F.lit(900.0).alias("high"))
    rules = headers.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.array_compact(F.array(rule(0.0), F.when(F.col("doc_id") % 2 == 0, rule(100.0)), rule(300.0), rule(500.0)))).alias("r")).select("doc_id", "page", "r.*")
    return L.columns_of(words(spark, sf), headers, L.column_regions(rules, headers)).select("doc_id", "row", "column", "text")


@query(f"SELECT doc_id, row * 4 + 1 AS ix, 10.0::DOUBLE AS distance, row AS point FROM ({_ROWS})")
def nearest_left(spark, sf):
    """The item whose centre is nearest to x = 160 in each row, taken as a page of its own, among those that end before 181."""
    w = words(spark, sf).withColumn("page", F.col("row"))
    points = w.select("doc_id", "page").distinct().withColumns({"point": F.col("page"), "x": F.lit(190.0)})
    return L.nearest(w.withColumn("x0", F.when(F.col("c") == 1, F.lit(180.0)).otherwise(F.col("x0"))), points, "left", 100.0).select("doc_id", "ix", "distance", "point")


@query(f"SELECT doc_id, 9 + 1 AS ix FROM ({_ROWS}) WHERE row = 2")
def numbers_below(spark, sf):
    """Below a heading at 250 on the first row the quantity of the second."""
    w = words(spark, sf)
    anchors = w.select("doc_id", "page").distinct().withColumns({"anchor": F.lit("q"), "a_row": F.lit(1), "x": F.lit(250.0)})
    return L.numbers_below(w, anchors).select("doc_id", "ix")


@query(f"SELECT doc_id, row, 'R' || k || ' ' || 'été' || s AS value, row * 4 AS first, row * 4 + 1 AS last FROM ({_ROWS}) r WHERE row = 1 OR EXISTS (SELECT 1 FROM ({_ROWS}) o WHERE o.doc_id = r.doc_id AND o.row = 1 AND o.k = r.k AND o.s = r.s)")
def value_places(spark, sf):
    """Reference and name of a page's first row, printed with other spacing and accents."""
    w = words(spark, sf)
    values = w.where("row = 1 AND c = 0").select("doc_id", F.concat(F.lit("R"), F.col("k").cast("string"), F.lit(" été"), F.col("s").cast("string")).alias("value"))
    return L.value_places(w, values).select("doc_id", "row", "value", "first", "last")


@query(f"SELECT doc_id, token, 5.0::DOUBLE AS dx, -2.0::DOUBLE AS dy FROM (SELECT DISTINCT doc_id FROM ({_ROWS})), (SELECT unnest(['commande', 'date']) AS token)")
def page_anchors(spark, sf):
    """Words that stand once on both pages; ``total`` stands twice, values aren't words."""
    pages = table(spark, sf, "lineitem").selectExpr(*_ROW).select("doc_id").distinct().withColumn("page", F.lit(1))
    spot = lambda t, x, y: F.struct(F.lit(t).alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 10).alias("x1"), F.lit(y + 10).alias("y1"))
    w = pages.select("doc_id", "page", F.explode(F.array(spot("Commandé", 0.0, 5.0), spot("DATE:", 50.0, 5.0), spot("Total", 0.0, 90.0), spot("total", 50.0, 90.0), spot("12", 70.0, 5.0))).alias("w")).select("doc_id", "page", "w.*")
    moved = w.withColumns({"x0": F.col("x0") + 5, "x1": F.col("x1") + 5, "y0": F.col("y0") - 2, "y1": F.col("y1") - 2})
    return L.page_anchors(w, moved).drop("page")


@query(f"SELECT doc_id, row, 20.0::DOUBLE AS x0, row * 20.0::DOUBLE AS y0, 460.0::DOUBLE AS x1, row * 20.0::DOUBLE + 11.5 AS y1, 4 AS n FROM ({_ROWS})")
def row_bands(spark, sf):
    return L.unions(words(spark, sf), ["doc_id", "row"])


@query(f"SELECT doc_id, row, 'A' AS label, string_agg(text, ' ' ORDER BY x0) AS text FROM ({_W}) WHERE c < 2 GROUP BY ALL UNION ALL SELECT doc_id, row, 'A', text FROM ({_W}) WHERE c = 3")
def merged_labels(spark, sf):
    w = words(spark, sf).withColumn("label", F.when(F.col("c") == 2, "O").otherwise("A"))
    return L.merged_labels(w).select("doc_id", "row", "label", "text")


@query(f"SELECT doc_id, ix, 'w=r' || k || ' s=Xd n1=été' || s || ' n2=' || CAST(q AS INT) AS context FROM ({_W}) WHERE c = 0")
def token_contexts(spark, sf):
    w = words(spark, sf)
    return L.token_contexts(w).join(w.where("c = 0").select("doc_id", "page", "ix"), ["doc_id", "page", "ix"], "left_semi").select("doc_id", "ix", "context")


@query("""WITH a AS (SELECT l_orderkey AS doc_id, 5.0 + CASE WHEN l_partkey % 10 = 0 THEN 90 ELSE l_partkey % 3 END AS dx, 1.0 + l_suppkey % 2 AS dy FROM lineitem), m AS (SELECT doc_id, median(dx) AS mx, median(dy) AS my, count(*) AS n FROM a GROUP BY 1),
i AS (SELECT doc_id, mx, my, n, count(*) FILTER (abs(dx - mx) <= 6 AND abs(dy - my) <= 6) AS inliers, max(greatest(abs(dx - mx), abs(dy - my))) FILTER (abs(dx - mx) <= 6 AND abs(dy - my) <= 6) AS spread FROM a JOIN m USING (doc_id) GROUP BY ALL)
SELECT doc_id, CAST(mx AS DOUBLE) AS mx, CAST(my AS DOUBLE) AS my, inliers, CASE WHEN inliers >= 2 AND inliers >= 0.75 * n AND inliers >= 3 AND spread <= 4 THEN 'HIGH' WHEN inliers >= 2 AND inliers >= 0.75 * n THEN 'MEDIUM' ELSE 'REJECTED' END AS confidence FROM i""")
def translation_consensus(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (5.0 + F.when(F.col("l_partkey") % 10 == 0, 90).otherwise(F.col("l_partkey") % 3)).alias("dx"), (1.0 + F.col("l_suppkey") % 2).alias("dy"))
    return spatial.translation(a).select("doc_id", "mx", "my", "inliers", "confidence")
