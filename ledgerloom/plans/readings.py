"""Queries of competing readings: three readings of every order's lines, scored against its printed total."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hypotheses as H
from .ordered import _LINE
from .registry import query, table

#: The lines with descriptions and references of which some are noise.
_BASE = [*_LINE, "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 0.5 + CAST(l_partkey % 50 AS DOUBLE) / 100 END AS reference_score", "CASE WHEN l_partkey % 6 = 0 THEN 'MISSING' WHEN l_partkey % 7 = 0 THEN 'ALPHA_ONLY' WHEN l_partkey % 50 >= 24 THEN 'SUPPORTED' ELSE 'ATYPICAL' END AS reference_status", "l_quantity AS q"]
_TEXT = "CASE WHEN k % 31 = 0 THEN 'Frais de port' WHEN k % 37 = 0 THEN 'Total HT' WHEN k % 41 = 0 THEN NULL ELSE concat('Pompe ', CAST(k AS STRING)) END"
_CODE = "CASE WHEN k % 43 = 0 THEN '12/05/2024' WHEN k % 47 = 0 THEN 'A B C' ELSE material END"


def readings(spark, sf):
    """All lines as the current reading; those with a tax as a native table; quantities off by one, without numbers from geometry."""
    base = table(spark, sf, "lineitem").selectExpr(*_BASE).withColumns({"description": F.expr(_TEXT), "material": F.expr(_CODE), "raw_text": F.lit(""), "net_unit_price": F.expr("CASE WHEN k % 9 = 0 THEN unit_price ELSE NULL END")})
    a = base.withColumns({"hyp": F.lit("current"), "rank": F.lit(0)})
    b = base.where("tax > 0.02").withColumns({"hyp": F.lit("native_table"), "rank": F.lit(1)})
    c = base.withColumns({"hyp": F.lit("geometry"), "rank": F.lit(2), "quantity": F.col("quantity") + 1, "line_total": F.when(F.col("k") % 2 == 0, F.col("line_total"))})
    return a.unionByName(b).unionByName(c)


def charges(spark, sf):
    of = table(spark, sf, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").cast("double").alias("amount"))
    return of.withColumn("hyp", F.lit("native_table")).unionByName(of.where("amount > 50").withColumn("hyp", F.lit("current")))


def targets(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("target"))


def _sql() -> str:
    there = lambda x: f"(coalesce(CAST({x} AS VARCHAR), '') <> '')::INT"
    return f"""WITH base AS (SELECT * REPLACE ({_TEXT} AS description, {_CODE} AS material, '' AS raw_text), CASE WHEN k % 9 = 0 THEN unit_price END AS net_unit_price FROM (SELECT {', '.join(_BASE)} FROM lineitem)),
r AS (SELECT *, 'current' AS hyp, 0 AS rank FROM base UNION ALL SELECT *, 'native_table', 1 FROM base WHERE tax > 0.02 UNION ALL SELECT * REPLACE (quantity + 1 AS quantity, CASE WHEN k % 2 = 0 THEN line_total END AS line_total), 'geometry', 2 FROM base),
x AS (SELECT *, coalesce(net_unit_price, unit_price) AS price, description IS NOT NULL AND coalesce(quantity, unit_price, line_total) IS NOT NULL AS ass FROM r),
p AS (SELECT doc_id, hyp, min(rank) AS rank, count(*) AS n, avg(({' + '.join(map(there, ('material', 'description', 'quantity', 'unit_price', 'line_total')))}) / 5) AS complete, count(description) AS described, count(*) FILTER (material IS NOT NULL AND material <> 'A B C') AS coded, 0 AS fragments,
 count(*) FILTER (quantity IS NOT NULL AND price IS NOT NULL AND line_total IS NOT NULL) AS seen, count(*) FILTER (abs(quantity * price - line_total) <= greatest(0.03, abs(line_total) * 0.01)) AS good, count(quantity * unit_price * line_total) AS checked, count(*) FILTER (abs(quantity * unit_price - line_total) <= greatest(0.04, abs(quantity * unit_price) * 0.006)) AS exact,
 count(coalesce(line_total, quantity * price)) AS with_amount, coalesce(CAST(sum(CAST(coalesce(line_total, quantity * price) AS DECIMAL(18,6))) AS DOUBLE), 0) AS line_sum, sum(CASE WHEN k % 31 = 0 THEN 1.0 ELSE 0 END + CASE WHEN k % 43 = 0 THEN 1.0 ELSE 0 END + CASE WHEN k % 31 <> 0 AND k % 37 = 0 THEN 0.75 ELSE 0 END) AS noise,
 count(*) FILTER (ass) AS assessed, count(*) FILTER (ass AND reference_status <> 'MISSING') AS eligible, count(*) FILTER (ass AND reference_status = 'SUPPORTED' AND reference_score >= 0.74) AS supported, coalesce(avg(reference_score) FILTER (ass AND reference_status = 'SUPPORTED' AND reference_score >= 0.74), 0) AS support,
 count(*) FILTER (ass AND reference_status = 'ALPHA_ONLY') AS severe, count(*) FILTER (ass AND reference_status = 'ATYPICAL') AS atypical FROM x GROUP BY doc_id, hyp),
c AS (SELECT l_orderkey AS doc_id, 'native_table' AS hyp, l_suppkey AS amount FROM lineitem WHERE l_linenumber = 7 UNION ALL SELECT l_orderkey, 'current', l_suppkey FROM lineitem WHERE l_linenumber = 7 AND l_suppkey > 50), g AS (SELECT doc_id, hyp, count(*) AS charges, sum(amount) AS charge_sum FROM c GROUP BY ALL),
j AS (SELECT p.*, coalesce(charges, 0) AS charges, line_sum + coalesce(charge_sum, 0) AS total, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS target, n / max(n) OVER (PARTITION BY doc_id) AS coverage,
 1.25 * complete + 0.22 * described / n + 0.15 * coded / n + least(n, 8) * 0.025 + CASE WHEN seen > 0 THEN 0.45 * good / seen - 0.55 * (seen - good) / seen ELSE 0 END - CASE WHEN n > 12 THEN least(0.75, (n - 12) * 0.055) ELSE 0 END AS quality FROM p LEFT JOIN g USING (doc_id, hyp) LEFT JOIN orders ON o_orderkey = doc_id),
k AS (SELECT *, CASE WHEN checked > 0 THEN exact / checked ELSE 0.55 END AS arith, abs(total - target) <= greatest(0.03, abs(target) * 0.005) AS near,
 CASE WHEN eligible > 0 THEN 0.14 * supported / eligible * support ELSE 0 END - 0.18 * (severe + 0.25 * atypical) / greatest(assessed, 1) AS pattern FROM j),
f AS (SELECT *, coalesce(CASE WHEN target > 0 AND with_amount / n >= 0.8 THEN with_amount / n * CASE WHEN near THEN 0.42 WHEN total >= 0 AND total < target THEN -0.38 * (1 - total / target) ELSE -least(0.38, 0.24 * abs(total - target) / target) END END, 0) AS total_fit, coalesce(target > 0 AND with_amount / n >= 0.8 AND near, false) AS reconciled FROM k),
s AS (SELECT *, 0.30 * quality + 0.34 * arith + 0.24 * complete + CASE hyp WHEN 'native_table' THEN 0.18 WHEN 'geometry' THEN 0.08 ELSE 0 END + least(0.08, 0.02 * charges) + pattern - least(0.40, 0.5 * noise / n) + total_fit + 0.08 * coverage AS score FROM f)"""


_S = _sql()
_CUT = "t AS (SELECT a.doc_id, a.hyp FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.hyp = 'current' WHERE a.hyp <> 'current' AND b.supported >= 4 AND b.supported - a.supported >= 2 AND a.n / b.n < 0.7 AND NOT a.reconciled)"


@query(_S + " SELECT doc_id, hyp, n, round(quality, 6) AS quality, round(arith, 6) AS arith, round(noise, 6) AS noise, round(pattern + 1e-9, 6) AS pattern, round(total_fit + 1e-9, 6) AS total_fit, reconciled, round(score + 1e-9, 6) AS score FROM s")
def hypothesis_scores(spark, sf):
    out = H.score(readings(spark, sf), charges(spark, sf), targets(spark, sf))
    # a little more than nothing lets exact halves go up in both engines
    return out.select("doc_id", "hyp", "n", *(F.round(c, 6).alias(c) for c in ("quality", "arith", "noise")), *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("pattern", "total_fit", "score")), "reconciled")


@query(f"{_S}, {_CUT} SELECT doc_id, hyp FROM t")
def hypothesis_rejections(spark, sf):
    return H.partial_rejections(H.score(readings(spark, sf), charges(spark, sf), targets(spark, sf)))


@query(f"{_S}, {_CUT} SELECT doc_id, hyp, n FROM s ANTI JOIN t USING (doc_id, hyp) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, n DESC, hyp) = 1")
def hypothesis_winner(spark, sf):
    return H.winner(H.score(readings(spark, sf), charges(spark, sf), targets(spark, sf))).select("doc_id", "hyp", "n")


@query(_S + " SELECT doc_id, hyp, n, round(quality, 6) AS quality FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(quality, 9) DESC, least(n, 20) DESC, rank) = 1")
def best_line_sets(spark, sf):
    return H.best_set(readings(spark, sf)).withColumn("quality", F.round("quality", 6))
