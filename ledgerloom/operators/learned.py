"""A learned router of documents: hashed character n-grams of a text's beginning and a linear model, with class probabilities, a family's prior, and how far a text is from what was learnt.

The model is Spark's own, so training and scoring are distributed; its hash is not that of other libraries, so models can't be exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import placeholders
from ..functions.text import identifier, let, structural_shape
from .scoring import out_of_distribution, temperature

CHARACTERS, GRAMS, FEATURES = 240, (2, 3, 4), 1 << 13
#: The temperature and weight of the family's prior.
TEMPERATURE, PRIOR_WEIGHT = 1.0, 1.0


def grams(text: Column, sizes: Sequence[int] = GRAMS, characters: int = CHARACTERS) -> Column:
    """All runs of characters of a text's beginning, dates and amounts replaced by their kind."""
    head = F.concat(F.lit(" "), F.substring(placeholders(text), 1, characters), F.lit(" "))
    return let(head, lambda h: F.concat(*(_runs(h, n) for n in sizes)))


def _runs(head: Column, n: int) -> Column:
    return F.when(F.length(head) >= n, F.transform(F.sequence(F.lit(1), F.length(head) - n + 1), lambda i: F.substring(head, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def train(rows: DataFrame, classes: Sequence[str], iterations: int = 12, strength: float = 0.01) -> PipelineModel:
    """A model over rows (text, target); ``classes`` fixes the order of the probabilities, a target outside them is left out."""
    index = F.array_position(F.array(*map(F.lit, classes)), F.col("target")) - 1
    known = rows.select(grams(F.col("text")).alias("grams"), index.cast("double").alias("label")).where("label >= 0")
    steps = [HashingTF(inputCol="grams", outputCol="counts", numFeatures=FEATURES), Normalizer(inputCol="counts", outputCol="features"), LogisticRegression(maxIter=iterations, regParam=strength, family="multinomial")]
    return Pipeline(stages=steps).fit(known)


def predict(rows: DataFrame, model: PipelineModel, classes: Sequence[str], priors: DataFrame | None = None, t: float = TEMPERATURE) -> DataFrame:
    """Adds ``probabilities`` (in the order of ``classes``), ``predicted``, ``confidence`` and ``ood``; with ``priors`` (family, decision, prior) and a column ``family``, the logarithms of the family's priors are added before the softmax."""
    names = F.array(*map(F.lit, classes))
    out = model.transform(rows.withColumn("grams", grams(F.col("text"))))
    p = vector_to_array("probability")
    out = out.withColumn("probabilities", p)
    if priors is not None:
        listed = priors.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("decision", "prior"))).alias("_prior"))  # classes, a few dozen
        out = out.join(F.broadcast(listed), "family", "left")
        blended = F.transform(F.arrays_zip("probabilities", names.alias("c")), lambda z: z["probabilities"] * F.pow(F.coalesce(F.element_at(F.col("_prior"), z["c"]), F.lit(1.0)), F.lit(PRIOR_WEIGHT)))
        out = out.withColumn("probabilities", blended).drop("_prior")
    out = out.withColumn("probabilities", temperature(F.col("probabilities"), t))
    best = F.array_max("probabilities")
    return out.select(*rows.columns, "probabilities", F.get(names, (F.array_position("probabilities", best) - 1).cast("int")).alias("predicted"), best.alias("confidence"), out_of_distribution(F.col("probabilities")).alias("ood"))


def shape_priors(rows: DataFrame) -> DataFrame:
    """(family, shape, prior): the share of each family's values (family, value) that have each shape."""
    shapes = rows.select("family", structural_shape(identifier(F.col("value"))).alias("shape")).where("shape <> ''")
    total = shapes.groupBy("family").agg(F.count("*").alias("total"))
    return shapes.groupBy("family", "shape").agg(F.count("*").alias("n")).join(F.broadcast(total), "family").select("family", "shape", (F.col("n") / F.col("total")).alias("prior"))


def json_object(x: Column) -> tuple[Column, Column]:
    """(JSON object, problem) recovered from free text: a fenced block's contents, or from the first brace to the last; null with a reason if there is none that parses."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "^(?i)```(?:json)?\\s*", ""), "\\s*```$", ""))
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    whole, part = F.try_parse_json(raw), F.try_parse_json(F.nullif(inner, F.lit("")))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    good = F.when(whole.isNotNull() & is_object(whole), raw).when(whole.isNull() & part.isNotNull() & is_object(part), inner)
    problem = F.when(good.isNotNull(), None).when(whole.isNotNull(), "JSON_NOT_OBJECT").when(~F.contains(raw, F.lit("{")), "NO_JSON_OBJECT").when(inner == "", "UNTERMINATED_JSON").otherwise("INVALID_JSON")
    return good, problem
