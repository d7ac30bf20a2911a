"""How good an extraction is: labels, values, boxes and whole documents against the truth, models against each other, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import contamination, coverage, iou
from ..functions.checksums import any_date
from ..functions.judgements import ladder
from ..functions.numbers import money
from ..functions.text import field_value, fold, identifier_small, let

#: Endings of paths whose values are compared as numbers, dates or identifiers.
NUMERIC = ("quantity", "unit_price", "line_total", "total_net", "total_tax", "total_gross", "amount")
DATES = ("order_date", "delivery_date", "date")
IDENTIFIERS = ("number", "reference", "sku", "ean", "vat_id", "siret", "siren", "postal_code")
#: Labels whose loss alone is a regression.
CRITICAL = ("ORDER_NUMBER", "ORDER_DATE", "TOTAL_NET", "LINE_ITEM_REFERENCE", "LINE_ITEM_QUANTITY")
#: Metrics in the order in which they decide between two models, and whether more is better.
ORDER = (("field_exact_match", True), ("field_token_f1", True), ("missing_field_rate", False), ("hallucination_rate", False), ("line_item_reference_recall", True))


def label_metrics(pairs: DataFrame, outside: str = "O", ignored: str = "IGNORED") -> DataFrame:
    """One row over (truth, prediction): accuracies, micro precision, recall and F1 without ``outside``, macro F1 over labels with support.

    Pairs with an ignored truth don't count. The confusion counts are made first, so the rest is a few rows.
    """
    counts = pairs.where(F.col("truth") != ignored).groupBy("truth", "prediction").agg(F.count("*").alias("n"))
    hit = F.col("truth") == F.col("prediction")
    inside = F.col("truth") != outside
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("support"), n(hit).alias("correct"), n(inside).alias("inside"), n(inside & hit).alias("hits"), n((F.col("prediction") != outside) & ~hit).alias("false_positives"))
    sides = F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(hit, F.col("n")).otherwise(0).alias("h")), F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))
    per = counts.select(F.explode(sides).alias("x")).select("x.*").where(F.col("label") != outside).groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    macro = per.where("t > 0").agg(F.avg(2.0 * F.col("h") / (F.col("t") + F.col("p"))).alias("macro"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    row = totals.crossJoin(F.broadcast(macro))  # one row each
    precision, recall = share(F.col("hits"), F.col("hits") + F.col("false_positives")), share(F.col("hits"), F.col("inside"))
    f1 = share(2.0 * F.col("hits"), F.col("hits") + F.col("false_positives") + F.col("inside"))
    r = lambda c: F.round(c, 9)
    return row.select("support", F.col("inside").alias("inside_support"), r(share(F.col("correct"), F.col("support"))).alias("token_accuracy"), r(recall).alias("inside_accuracy"), r(precision).alias("precision"), r(recall).alias("recall"), r(f1).alias("f1"), r(F.coalesce("macro", F.lit(0.0))).alias("macro_f1"))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of two values' letters and digits over the longer one; 0 if one is empty."""

    def near(v: Column) -> Column:
        x, y = v["x"], v["y"]
        longest = F.greatest(F.length(x), F.length(y))
        return F.when((x == "") | (y == ""), F.when(x == y, 1.0).otherwise(0.0)).when(x == y, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)

    return let(F.struct(field_value(a).alias("x"), field_value(b).alias("y")), near)


def value_metrics(records: DataFrame) -> DataFrame:
    """(label, support, ...) of records (label, truth, candidate, baseline, baseline_present) for each label and, with a null label, for all.

    Exact is a similarity of 1 with a truth that holds something; soft is 0.9 or more.
    """
    there = field_value(F.col("truth")) != ""
    close = lambda c: similarity(F.col(c), F.col("truth"))
    scored = records.select(F.coalesce("label", F.lit("UNKNOWN")).alias("label"), there.alias("there"), close("candidate").alias("c"), F.when(F.col("baseline_present"), close("baseline")).otherwise(0.0).alias("b"), "baseline_present")
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    exact = lambda s: F.col("there") & (F.col(s) == 1.0)
    return scored.rollup("label").agg(F.count("*").alias("support"), share(exact("c")).alias("candidate_exact"), share(F.col("c") >= 0.9).alias("candidate_soft"), share(exact("b")).alias("baseline_exact"), share(F.col("b") >= 0.9).alias("baseline_soft"), share(F.col("baseline_present")).alias("baseline_coverage"))


def decision(values: DataFrame, documents: Column, token_f1: Column, least_documents: int = 10) -> DataFrame:
    """One row: what ``value_metrics`` advise for a candidate, and the critical labels that lose over 0.02. Promotion itself stays manual."""
    lost = F.col("label").isin(*CRITICAL) & (F.col("support") >= 2) & (F.col("candidate_exact") - F.col("baseline_exact") < -0.02)
    total = lambda c: F.max(F.when(F.col("label").isNull(), F.col(c)))
    row = values.agg(total("candidate_exact").alias("candidate"), total("baseline_exact").alias("baseline"), F.sort_array(F.collect_set(F.when(lost, F.col("label")))).alias("regressions"))
    status = ladder(
        (documents < least_documents, "INSUFFICIENT_HOLDOUT"), (F.array_size("regressions") > 0, "REGRESSION"), ((F.col("candidate") > F.col("baseline")) & (token_f1 >= 0.70), "CANDIDATE_BETTER"),
        (F.col("candidate") < F.col("baseline"), "REGRESSION"), otherwise="REVIEW_REQUIRED",
    )
    return row.select(status.alias("status"), "regressions", F.lit(False).alias("automatic_promotion"))


def _box(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{i}") for i in range(4))


def greedy_matches(predicted: DataFrame, truth: DataFrame, group: list[str]) -> DataFrame:
    """Predictions in their order each take the free truth of their group that they overlap most: (group, pix, tix, iou, coverage, contamination).

    ``predicted`` has the group, pix and p0 to p3, ``truth`` tix and t0 to t3. Only boxes that overlap are paired. A group's pairs are folded in one row,
    as each choice hangs on those before; groups are the boxes of one kind on one page.
    """
    p, t = _box("p"), _box("t")
    pairs = predicted.join(truth, group).withColumn("iou", iou(p, t)).where("iou > 0")
    pairs = pairs.select(*group, F.struct("pix", (-F.col("iou")).alias("less"), "tix", coverage(p, t).alias("coverage"), contamination(p, t).alias("contamination")).alias("m"))
    kind = pairs.schema["m"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.array().cast("array<int>").alias("pix"), F.array().cast("array<int>").alias("tix"))

    def step(s: Column, m: Column) -> Column:
        free = ~F.array_contains(s["pix"], m["pix"]) & ~F.array_contains(s["tix"], m["tix"])
        taken = F.struct(F.array_append(s["out"], m).alias("out"), F.array_append(s["pix"], m["pix"]).alias("pix"), F.array_append(s["tix"], m["tix"]).alias("tix"))
        return F.when(free, taken).otherwise(s)

    chosen = pairs.groupBy(*group).agg(F.sort_array(F.collect_list("m")).alias("m")).select(*group, F.explode(F.aggregate("m", start, step)["out"]).alias("m"))
    return chosen.select(*group, "m.pix", "m.tix", (-F.col("m.less")).alias("iou"), "m.coverage", "m.contamination")


def spatial_metrics(predicted: DataFrame, truth: DataFrame, group: list[str], by: str, thresholds: tuple[float, ...] = (0.50, 0.75, 0.90)) -> DataFrame:
    """For each ``by``: counts of boxes and matches, mean overlap, and the share of truths that are met at each threshold."""
    matches = greedy_matches(predicted, truth, group)
    recalls = [F.count_if(F.col("iou") >= x).alias(f"r{int(100 * x)}") for x in thresholds]
    m = matches.groupBy(by).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean"), F.avg("coverage").alias("mean_coverage"), F.avg("contamination").alias("mean_contamination"), *recalls)
    p, t = (d.groupBy(by).agg(F.count("*").alias(c)) for d, c in ((predicted, "predicted"), (truth, "truth")))
    rows = p.join(t, by, "full").join(m, by, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    share = [F.round(n(f"r{int(100 * x)}") / F.greatest(n("truth"), F.lit(1)), 9).alias(f"recall_{int(100 * x)}") for x in thresholds]
    return rows.select(by, n("truth").alias("truth"), n("predicted").alias("predicted"), n("matched").alias("matched"), *(F.round(n(c), 9).alias(a) for c, a in (("mean", "mean_iou"), ("mean_coverage", "mean_coverage"), ("mean_contamination", "mean_contamination"))), *share)


def same_value(path: Column, a: Column, b: Column) -> Column:
    """Equality by what the path's last name says the value is: a number, a date, an identifier or words."""
    ending = F.element_at(F.split(path, r"\."), -1)
    return F.coalesce(F.when(ending.isin(*NUMERIC), money(a) == money(b)).when(ending.isin(*DATES), any_date(a) == any_date(b)).when(ending.isin(*IDENTIFIERS), identifier_small(a) == identifier_small(b)).otherwise(fold(a) == fold(b)), F.lit(False))


def words_f1(a: Column, b: Column) -> Column:
    """F1 of two texts' multisets of words; 1 if both have none."""
    words = lambda c: F.filter(F.split(fold(c), " "), lambda w: w != "")
    of = lambda arr, w: F.array_size(F.filter(arr, lambda v: v == w))

    def score(v: Column) -> Column:
        x, y = v["x"], v["y"]
        shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, w: s + F.least(of(x, w), of(y, w)))
        return F.when((F.array_size(x) == 0) & (F.array_size(y) == 0), 1.0).otherwise(2.0 * shared / (F.array_size(x) + F.array_size(y)))

    return let(F.struct(words(a).alias("x"), words(b).alias("y")), score)


def field_details(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, path, expected, actual, match, token_f1) for the union of both sides' paths (doc_id, path, value) that hold something."""
    side = lambda d, name: d.where(F.coalesce("value", F.lit("")) != "").select("doc_id", "path", F.col("value").alias(name))
    rows = side(truth, "expected").join(side(predicted, "actual"), ["doc_id", "path"], "full")
    dated = F.element_at(F.split("path", r"\."), -1).isin(*DATES)
    match = F.when(F.col("expected").isNotNull(), F.col("actual").isNotNull() & same_value(F.col("path"), F.col("expected"), F.col("actual")))
    f1 = F.when(F.col("expected").isNotNull(), F.when(F.col("actual").isNull(), 0.0).when(dated, F.col("match").cast("double")).otherwise(words_f1(F.col("expected"), F.col("actual"))))
    return rows.withColumn("match", match).withColumn("token_f1", f1)


def extraction_metrics(details: DataFrame) -> DataFrame:
    """Each document's exact and token scores, missing and invented fields, and how many references of its lines were found."""
    wanted, found = F.col("expected").isNotNull(), F.col("actual").isNotNull()
    reference = F.col("path").rlike(r"^lines\[[0-9]+\]\.reference$")
    refs = lambda c: F.collect_set(F.when(reference, identifier_small(F.col(c))))
    per = details.groupBy("doc_id").agg(F.count_if(wanted).alias("truth_fields"), F.count_if(found).alias("predicted_fields"), F.count_if(F.col("match")).alias("exact"), F.avg("token_f1").alias("f1"), F.count_if(wanted & ~found).alias("missing"), F.count_if(found & ~wanted).alias("invented"), refs("expected").alias("er"), refs("actual").alias("ar"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 9))
    recall = F.when(F.array_size("er") > 0, F.round(F.array_size(F.array_intersect("er", "ar")) / F.array_size("er"), 9))
    return per.select("doc_id", "truth_fields", "predicted_fields", "exact", share("exact", "truth_fields").alias("field_exact_match"), F.round("f1", 9).alias("field_token_f1"), share("missing", "truth_fields").alias("missing_field_rate"), F.coalesce(share("invented", "predicted_fields"), F.lit(0.0)).alias("hallucination_rate"), recall.alias("line_item_reference_recall"))


def model_summary(documents: DataFrame) -> DataFrame:
    """Each model's counts and means over documents (model, error, json_valid, metrics, latency, rss); nulls don't count."""
    ok = F.col("error").isNull()
    mean = lambda c: F.round(F.avg(F.when(ok, F.col(c))), 9).alias(c)
    valid = F.round(F.coalesce(F.avg(F.when(ok, F.coalesce("json_valid", F.lit(True)).cast("int"))), F.lit(0.0)), 9)
    return documents.groupBy("model").agg(F.count("*").alias("documents"), F.count_if(ok).alias("completed"), F.count("error").alias("errors"), valid.alias("json_valid_rate"), *(mean(m) for m, _ in ORDER), mean("latency"), F.max(F.when(ok, F.col("rss"))).alias("rss_max"))


def field_comparison(baseline: DataFrame, candidates: DataFrame) -> DataFrame:
    """(model, doc_id, path, outcome, delta): fields of candidates against the baseline's, documents with an error left out on both sides.

    Both have doc_id, path, match, token_f1; candidates also model. A model is compared over every path that it or the baseline has.
    """
    models = candidates.select("model").distinct()
    base = baseline.select("doc_id", "path", F.col("match").alias("b"), F.col("token_f1").alias("bf")).join(F.broadcast(models))  # a handful of models
    rows = candidates.select("model", "doc_id", "path", F.col("match").alias("c"), F.col("token_f1").alias("cf")).join(base, ["model", "doc_id", "path"], "full")
    c, b = (F.coalesce(x, F.lit(False)) for x in ("c", "b"))
    outcome = ladder((c & b, "BOTH_CORRECT"), (c, "CANDIDATE_WIN"), (b, "BASELINE_WIN"), otherwise="BOTH_WRONG")
    return rows.select("model", "doc_id", "path", outcome.alias("outcome"), F.round(F.coalesce("cf", F.lit(0.0)) - F.coalesce("bf", F.lit(0.0)), 9).alias("delta"))


def head_to_head(baseline: DataFrame, candidates: DataFrame) -> DataFrame:
    """(model, doc_id, status, winner): the first metric of ``ORDER`` that differs by over 1e-12 decides; else TIE. Both have doc_id, error and the metrics."""
    names = [m for m, _ in ORDER]
    models = candidates.select("model").distinct()
    base = baseline.select("doc_id", F.lit(True).alias("has_b"), F.col("error").alias("b_error"), *(F.col(m).alias(f"b_{m}") for m in names)).join(F.broadcast(models))  # a handful of models
    rows = candidates.select("model", "doc_id", F.lit(True).alias("has_c"), "error", *names).join(base, ["model", "doc_id"], "full")
    scored = F.coalesce(*names).isNotNull() & F.coalesce(*(F.col(f"b_{m}") for m in names)).isNotNull()
    status = ladder((F.col("has_b").isNull() | F.col("has_c").isNull(), "MISSING_DOCUMENT_RESULT"), (F.col("error").isNotNull() | F.col("b_error").isNotNull(), "ERROR"), (~scored, "UNSCORED"), otherwise="COMPARABLE")
    better = [F.when(F.abs(F.col(m) - F.col(f"b_{m}")) > 1e-12, F.when((F.col(m) > F.col(f"b_{m}")) == F.lit(more), "CANDIDATE").otherwise("BASELINE")) for m, more in ORDER]
    winner = F.when(F.col("status") == "COMPARABLE", F.coalesce(*better, F.lit("TIE"))).otherwise("UNAVAILABLE")
    return rows.withColumn("status", status).select("model", "doc_id", "status", winner.alias("winner"))


def head_to_head_summary(rows: DataFrame) -> DataFrame:
    """Each model's documents compared, won, lost and tied."""
    won = lambda w: F.count_if((F.col("status") == "COMPARABLE") & (F.col("winner") == w))
    return rows.groupBy("model").agg(F.count_if(F.col("status") == "COMPARABLE").alias("compared"), won("CANDIDATE").alias("won"), won("BASELINE").alias("lost"), won("TIE").alias("tied"))


def address_verdict(expected: Column, actual: Column) -> Column:
    """INCORRECT if the postal codes have none in common; else by how many of the expected words are there: 0.72 CORRECT, 0.45 PARTIAL."""
    words = lambda c: F.array_distinct(F.filter(F.split(fold(c), " "), lambda w: w != ""))
    codes = lambda w: F.filter(w, lambda x: x.rlike("^[0-9]{5}$"))

    def judge(v: Column) -> Column:
        apart = (F.array_size(codes(v["e"])) > 0) & (F.array_size(codes(v["a"])) > 0) & ~F.arrays_overlap(codes(v["e"]), codes(v["a"]))
        recall = F.array_size(F.array_intersect(v["e"], v["a"])) / F.array_size(v["e"])
        return ladder((F.array_size(v["e"]) == 0, None), (apart, "INCORRECT"), (recall >= 0.72, "CORRECT"), (recall >= 0.45, "PARTIAL"), otherwise="INCORRECT")

    return let(F.struct(words(expected).alias("e"), words(actual).alias("a")), judge)


def date_audit(source: Column, model: Column, labelled: Column) -> Column:
    """How the sets of delivery dates in the source and in the model's answer meet."""
    s, m = F.array_size(source), F.array_size(model)
    shared = F.array_size(F.array_intersect(source, model))
    return ladder(
        ((s > 0) & (m > 0) & (shared == s) & (shared == m), "SOURCE_MATCH"), ((s > 0) & (shared > 0), "PARTIAL_MATCH"), ((s > 0) & (m == 0), "MODEL_MISSING"), (s > 0, "DATE_MISMATCH"),
        (labelled & (m == 0), "LABEL_WITHOUT_DATE_REVIEW"), (m > 0, "MODEL_ONLY_REVIEW"), otherwise="NO_DELIVERY_DATE_SIGNAL",
    )


def ranked_splits(documents: DataFrame, policy: str, share: float = 0.15) -> DataFrame:
    """(doc_id, split) by exact sizes: ordered by SHA-256 of ``policy:id`` the first go to test, the next to validation, the rest to training.

    The order is total, but no task sorts it all: the counts of hash ranges (4096 of them) tell which range holds each cut, and only rows of those two are ranked.
    """
    from ..functions.numbers import split_sizes

    hashed = documents.select("doc_id", F.sha2(F.concat(F.lit(policy + ":"), F.col("doc_id").cast("string")), 256).alias("h")).withColumn("r", F.substring("h", 1, 3))
    counts = hashed.groupBy("r").agg(F.count("*").alias("n"))
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select(split_sizes(F.col("total")).alias("s"))
    before = F.coalesce(F.sum("n").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # 4096 rows at most
    ranges = counts.withColumn("before", before).crossJoin(F.broadcast(sizes))
    cuts = [F.col("s.test"), F.col("s.test") + F.col("s.validation")]
    split_at = lambda first: ladder((first < cuts[0], "test"), (first < cuts[1], "validation"), otherwise="train")
    ranges = ranges.withColumn("whole", split_at(F.col("before")) == split_at(F.col("before") + F.col("n") - 1))
    rows = hashed.join(F.broadcast(ranges), "r")
    sure = rows.where("whole").select("doc_id", split_at(F.col("before")).alias("split"))
    place = F.col("before") + F.row_number().over(W.partitionBy("r").orderBy("h", "doc_id")) - 1
    return sure.unionByName(rows.where("NOT whole").withColumn("place", place).select("doc_id", split_at(F.col("place")).alias("split")))


def label_support(rows: DataFrame, least: int = 1) -> DataFrame:
    """(label, tokens, documents) of labelled tokens (doc_id, label)."""
    return rows.groupBy("label").agg(F.count("*").alias("tokens"), F.count_distinct("doc_id").alias("documents")).where(F.col("tokens") >= least)


def temperature(probabilities: Column, t: float) -> Column:
    """Softmax of the logarithms over a temperature."""
    logs = F.transform(probabilities, lambda p: F.ln(F.greatest(p, F.lit(1e-12))) / t)
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def out_of_distribution(probabilities: Column) -> Column:
    """0 to 1 from the best class and the entropy: 0.62 (1 - p) + 0.38 entropy / ln k."""
    entropy = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    value = 0.62 * (1 - F.array_max(probabilities)) + 0.38 * entropy / F.ln(F.greatest(F.array_size(probabilities), F.lit(2)).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def top_classes(classes: Column, probabilities: Column, k: int) -> Column:
    """The k most likely (p, class), ties by class."""
    zipped = F.arrays_zip(probabilities.alias("p"), classes.alias("class"))
    return F.slice(F.array_sort(F.transform(zipped, lambda z: F.struct((-z["p"]).alias("less"), z["class"].alias("class")))), 1, k)


def family_prior(rows: DataFrame) -> DataFrame:
    """(family, decision, prior): shares of each family's decisions with one added to every count, for all decisions that occur anywhere."""
    decisions = rows.select("decision").distinct()
    families = rows.groupBy("family").agg(F.count("*").alias("total"))
    k = decisions.agg(F.count("*").alias("k"))
    counts = rows.groupBy("family", "decision").agg(F.count("*").alias("n"))
    grid = families.crossJoin(F.broadcast(decisions)).crossJoin(F.broadcast(k))  # classes, a few dozen
    return grid.join(counts, ["family", "decision"], "left").select("family", "decision", ((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("k"))).alias("prior"))


def unit(vector: Column) -> Column:
    """The vector over its Euclidean length; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def nearest_class(vector: Column, queries: list[tuple[str, list[float]]]) -> Column:
    """The class whose query vector has the largest dot product; ties go to the first. ``queries`` is a short list."""
    dot = lambda q: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, q)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.array_max(F.array(*(F.struct(F.round(dot(q), 12).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("class")) for i, (name, q) in enumerate(queries))))["class"]
