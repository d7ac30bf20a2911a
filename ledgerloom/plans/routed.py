"""Queries of the learned router, of shapes of numbers by family, and of JSON in free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learned as L
from .probes import probe
from .registry import query, table

CLASSES = ("de", "en", "es", "fr")


@query()
def learned_families(spark, sf):
    """Languages as families: learnt from four fifths of the documents that have one, predicted for the rest."""
    d = table(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").alias("target"))
    model = L.train(d.where("doc_id % 5 <> 0"), CLASSES)
    return L.predict(d.where("doc_id % 5 = 0"), model, CLASSES).select("doc_id", "target", "predicted", F.round("confidence", 3).alias("confidence"))


@query("""WITH s AS (SELECT c_mktsegment AS family, CASE c_custkey % 3 WHEN 0 THEN 'A-9' WHEN 1 THEN '9' ELSE 'A9/9' END AS shape FROM customer), t AS (SELECT family, count(*) AS total FROM s GROUP BY 1) SELECT family, shape, count(*) / max(total) AS prior FROM s JOIN t USING (family) GROUP BY ALL""")
def number_shape_priors(spark, sf):
    k = F.col("c_custkey").cast("string")
    value = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("po - "), k)).when(F.col("c_custkey") % 3 == 1, k).otherwise(F.concat(F.lit("AB"), k, F.lit("/12")))
    return L.shape_priors(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("family"), value.alias("value")))


probe("json_recovery", {"number": lambda x: F.get_json_object(L.json_object(x)[0], "$.n"), "problem": lambda x: L.json_object(x)[1]}, [
    ('{"n": {k}}', "{k}", None), ('```json\n{"n": {k}}\n```', "{k}", None), ('Here: {"n": {k}} done', "{k}", None), ("[1]", None, "JSON_NOT_OBJECT"), ("none", None, "NO_JSON_OBJECT"), ('{"n": 1', None, "UNTERMINATED_JSON"), ('{"n": }', None, "INVALID_JSON"), (None, None, "NO_JSON_OBJECT"),
])
