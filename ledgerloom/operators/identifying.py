"""Identifiers and references in printed lines: tax and registration numbers with the party whose they are, quotation titles, references after labels, grouped orders, table rows that belong to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.checksums import any_date, registration, vat, vat_of
from ..functions.judgements import any_of, ladder, valid_reference
from ..functions.numbers import accounting
from ..functions.text import fold_spaces, let, reference_key, squeezed, upper_spaces, upper_words

#: Words that name a role.
BUYER, SUPPLIER = ("CLIENT", "ACHETEUR", "BUYER", "DONNEUR D ORDRE"), ("FOURNISSEUR", "SUPPLIER", "VENDOR")


def party_role(context: Column) -> Column:
    """buyer or supplier if the text names only one of them, else unknown."""
    named = lambda low: F.struct(any_of(low, BUYER).alias("b"), any_of(low, SUPPLIER).alias("s"))
    return let(named(upper_spaces(context)), lambda v: ladder((v["b"] & ~v["s"], "buyer"), (v["s"] & ~v["b"], "supplier"), otherwise="unknown"))


def with_roles(lines: DataFrame) -> DataFrame:
    """Adds role, role_confidence and role_rule to lines (doc_id, ix, text): what the line itself says (0.995), else what the five lines before it say (0.94); never later ones."""
    before = F.array_join(F.collect_list("text").over(W.partitionBy("doc_id").orderBy("ix").rowsBetween(-5, -1)), " ")
    rows = lines.withColumns({"_own": party_role(F.col("text")), "_before": before}).withColumn("_earlier", party_role(F.col("_before")))
    own, earlier = F.col("_own") != "unknown", F.col("_earlier") != "unknown"
    return rows.withColumns({
        "role": F.when(own, F.col("_own")).otherwise(F.col("_earlier")), "role_confidence": ladder((own, 0.995), (earlier, 0.94), otherwise=0.0),
        "role_rule": ladder((own, "explicit_role_on_identifier_line"), (earlier, "preceding_role_heading"), otherwise="unresolved"),
    }).drop("_own", "_before", "_earlier")


def tax_identifiers(lines: DataFrame) -> DataFrame:
    """(doc_id, kind, value, valid, role, ix): VAT numbers, SIRET and SIREN of lines, each value once a document, on the line with the surest role.

    Numbers may be printed in groups. A VAT number that a valid registration gives, and that isn't printed, is added as derived.
    """
    text = F.upper(squeezed(F.col("text")))
    bare = lambda a: F.transform(a, lambda v: F.regexp_replace(v, "[^A-Z0-9]", ""))
    printed = bare(F.regexp_extract_all(text, F.lit(r"\bFR ?(?:[0-9] ?){11}(?![0-9])"), 0))
    labelled = lambda label, n: bare(F.regexp_extract_all(text, F.lit(rf"\b{label}[^0-9]{{0,12}}((?:[0-9][ .]?){{{n}}})(?![0-9])"), 1))
    tagged = lambda kind, a, ok: F.transform(a, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), ok(v).alias("valid")))
    found = F.concat(tagged("VAT", printed, vat), tagged("SIRET", labelled("SIRET", 14), registration), tagged("SIREN", labelled("SIREN", 9), registration))
    rows = with_roles(lines).withColumn("e", F.explode(found)).select("doc_id", "ix", "e.*", "role", "role_confidence")
    derived = rows.where("valid AND kind <> 'VAT'").select("doc_id", "ix", F.lit("VAT_DERIVED").alias("kind"), vat_of(F.substring("value", 1, 9)).alias("value"), F.lit(True).alias("valid"), "role", "role_confidence")
    derived = derived.join(rows.where("kind = 'VAT'").select("doc_id", "value").distinct(), ["doc_id", "value"], "left_anti")
    best = F.min_by(F.struct("valid", "role", "ix"), F.struct(-F.col("role_confidence"), F.col("ix"))).alias("b")
    return rows.unionByName(derived).groupBy("doc_id", "kind", "value").agg(best).select("doc_id", "kind", "value", "b.*")


def tax_rank(valid: Column, trusted: Column, confidence: Column, role: Column) -> Column:
    """Sorts identifiers, the best first: trusted and valid, valid, others; then confidence, then a known role."""
    return F.struct(-ladder((trusted & valid, 2), (valid, 1), otherwise=0), -confidence, -role.isin("buyer", "supplier").cast("int"))


def quotation_reference(line: Column) -> Column:
    """The reference on a title of a request for prices; page counts are none."""
    up = upper_spaces(line)
    tail = F.regexp_extract(up, r"\b(?:DEMANDE DE(?: PAGE)? PRIX|REQUEST FOR (?:QUOTATION|QUOTE)|RFQ)\b(.*)$", 1)
    words = F.filter(F.split(F.trim(F.regexp_replace(tail, "[^A-Z0-9./-]+", " ")), " "), lambda w: w.rlike("[A-Z]") & w.rlike("[0-9]") & (F.length(w) >= 4))
    numeric = F.regexp_extract(tail, r"\b(?:N°|NO|NUMERO|REF|N)[ .:°]*([0-9]{4,})", 1)
    return F.coalesce(F.btrim(F.get(words, F.lit(0)), F.lit(" .,:;#-/")), F.nullif(numeric, F.lit("")))


def references_after(text: Column, label: str, reach: int = 140) -> Column:
    """The distinct valid references right after each mention of a label, with those that commas or ``et`` join to them."""
    up = upper_spaces(text)
    tails = F.regexp_extract_all(up, F.lit(rf"\b(?:{label})S?\b ?(?:N(?:°|O|UMERO)?|#)? ?[:.=-]? ?(.{{0,{reach}}})"), 1)

    def chain(tail: Column) -> Column:
        parts = F.split(F.regexp_replace(tail, r" ?(?:,|;|\+|\bET\b|\bAND\b) ?(?:N(?:°|O)? )?", "\u0001"), "\u0001")
        first = F.transform(parts, lambda p: F.btrim(F.substring_index(F.trim(p), " ", 1), F.lit(" .,:;#-/")))
        ends = F.transform(parts, lambda p: F.contains(F.trim(p), F.lit(" ")))  # more words: the chain ends there
        stop = F.array_position(ends, F.lit(True))
        kept = F.when(stop > 0, F.slice(first, F.lit(1), stop.cast("int"))).otherwise(first)
        bad = F.array_position(F.transform(kept, lambda v: ~valid_reference(v)), F.lit(True))
        return F.when(bad > 0, F.slice(kept, F.lit(1), (bad - 1).cast("int"))).otherwise(kept)

    return F.array_distinct(F.flatten(F.transform(tails, chain)))


def without_materials(values: Column, materials: Column) -> Column:
    """References that are no article's key."""
    keys = F.transform(materials, reference_key)
    return F.filter(values, lambda v: ~F.array_contains(keys, reference_key(v)))


def header_column(headers: Column, markers: tuple[str, ...], excluded: tuple[str, ...] = ()) -> Column:
    """The place, from 0, of the first header that holds a marker and nothing excluded; null if none."""
    fits = F.transform(headers, lambda h: any_of(upper_spaces(h), markers) & (~any_of(upper_spaces(h), excluded) if excluded else F.lit(True)))
    at = F.array_position(fits, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def same_number(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.01), F.abs(b) * 0.0001), F.lit(False))


def row_matches(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, row, line, score): table rows (doc_id, row, material, quantity, amount, description) in their order each take the free line that fits best.

    An equal reference counts 8, one that ends with the other 6, quantity and amount 3 each, twice the likeness of the descriptions. Without a printed reference
    a row needs all of quantity, amount and a likeness of 0.55. Cells are printed text.
    """
    from .addressbook import ratio

    r = rows.select("doc_id", "row", reference_key(F.col("material")).alias("rm"), accounting(F.col("quantity")).alias("rq"), accounting(F.col("amount")).alias("ra"), upper_words(F.col("description")).alias("rd"))
    n = lines.select("doc_id", F.col("ix").alias("line"), reference_key(F.col("material")).alias("lm"), F.col("quantity").alias("lq"), F.col("line_total").alias("la"), upper_words(F.col("description")).alias("ld"))
    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda w: F.length(w) > 2)
    rw, lw = words(F.col("rd")), words(F.col("ld"))
    jaccard = F.array_size(F.array_intersect(rw, lw)) / F.greatest(F.lit(1), F.array_size(F.array_union(rw, lw)))
    exact = (F.col("rm") != "") & (F.col("rm") == F.col("lm"))
    close = (F.length("rm") >= 5) & (F.length("lm") >= 5) & (F.endswith("rm", "lm") | F.endswith("lm", "rm"))
    q, a = same_number(F.col("rq"), F.col("lq")), same_number(F.col("ra"), F.col("la"))
    pairs = r.join(n, "doc_id").where((F.col("rm") == "") | exact | close)
    likeness = F.when((F.col("rd") == "") | (F.col("ld") == ""), 0.0).otherwise(F.greatest(jaccard, ratio("rd", "ld")))
    pairs = pairs.withColumn("like", likeness)
    pairs = pairs.where((F.col("rm") != "") | (q & a & (F.col("like") >= 0.55)))
    score = ladder((exact, 8.0), (F.col("rm") != "", 6.0), otherwise=0.0) + F.when(q, 3.0).otherwise(0.0) + F.when(a, 3.0).otherwise(0.0) + 2.0 * F.col("like")
    return greedy(pairs.select("doc_id", "row", "line", F.round(score, 9).alias("score")), "doc_id", "row", "line", "score")


def greedy(pairs: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """Of scored pairs, one to one: each left in order takes the free right with the best score, ties to the first. A group's pairs are folded in one row."""
    kind = "array<struct<l:int,less:double,r:int>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.array().cast("array<int>").alias("ls"), F.array().cast("array<int>").alias("rs"))
    listed = F.sort_array(F.collect_list(F.struct(F.col(left).cast("int").alias("l"), (-F.col(score)).alias("less"), F.col(right).cast("int").alias("r"))))

    def step(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["ls"], p["l"]) & ~F.array_contains(s["rs"], p["r"])
        return F.when(free, F.struct(F.array_append(s["out"], p).alias("out"), F.array_append(s["ls"], p["l"]).alias("ls"), F.array_append(s["rs"], p["r"]).alias("rs"))).otherwise(s)

    chosen = pairs.groupBy(group).agg(listed.alias("p")).select(group, F.explode(F.aggregate("p", start, step)["out"]).alias("m"))
    return chosen.select(group, F.col("m.l").alias(left), F.col("m.r").alias(right), (-F.col("m.less")).alias(score))


def commercial_references(evidence: DataFrame) -> DataFrame:
    """(doc_id, kind, number, scope, lines, pages): one record for each reference of evidence (doc_id, kind, number, line, page, from_table, collides).

    A reference that any line has is the line's, else the document's; one that only repeats an article's key is dropped unless a table's column names it.
    """
    kept = evidence.groupBy("doc_id", "kind", "number").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.sort_array(F.collect_set("page")).alias("pages"), F.max(F.col("from_table").cast("int")).alias("t"), F.max(F.col("collides").cast("int")).alias("c"))
    return kept.where("t = 1 OR c = 0").select("doc_id", "kind", "number", F.when(F.array_size("lines") > 0, "line").otherwise("document").alias("scope"), "lines", "pages")


def pick(candidates: DataFrame) -> DataFrame:
    """(doc_id, value, confidence, n): the value of candidates (doc_id, value, confidence) with the highest confidence, then the most of them; none if two values share the highest confidence."""
    per = candidates.groupBy("doc_id", "value").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    top = per.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("confidence", "n", "value")), asc=False), 1, 2).alias("t"))  # the distinct values of a document
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return top.where(second.isNull() | (second["confidence"] != first["confidence"])).select("doc_id", first["value"].alias("value"), first["confidence"].alias("confidence"), first["n"].alias("n"))


def promoted_fields(values: DataFrame) -> DataFrame:
    """(doc_id, field, value, page, conflict): fields (doc_id, field, page, value) whose pages agree get the first page's value; the others are conflicts."""
    key = upper_words(F.col("value"))
    per = values.withColumn("k", key).where("k <> ''").groupBy("doc_id", "field").agg(F.count_distinct("k").alias("kinds"), F.min(F.struct("page", "value")).alias("f"))
    return per.select("doc_id", "field", F.when(F.col("kinds") == 1, F.col("f.value")).alias("value"), F.when(F.col("kinds") == 1, F.col("f.page")).alias("page"), (F.col("kinds") > 1).alias("conflict"))


def grouped_orders(lines: DataFrame) -> DataFrame:
    """(doc_id, number, lines, priced, total) of orders in one document: a line ``ref`` opens a group, ``product`` and ``price`` lines belong to the last opened. Lines have doc_id, ix, kind, number, amount."""
    open_ = F.last("number", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("ix"))
    rows = lines.withColumn("number", F.when(F.col("kind") == "ref", F.col("number"))).withColumn("open", open_).where("kind <> 'ref' AND open IS NOT NULL")
    return rows.groupBy("doc_id", F.col("open").alias("number")).agg(F.count_if(F.col("kind") == "product").alias("lines"), F.count("amount").alias("priced"), F.coalesce(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("total"))


def delivery_dates(lines: DataFrame, label: str = r"\b(livraison|delivery)\b", reach: int = 4) -> DataFrame:
    """(doc_id, dates, labelled): the distinct dates on a line with the label or the lines right after it, up to ``reach``. Lines have doc_id, ix, text."""
    labelled = fold_spaces(F.col("text")).rlike(label)
    near = F.max(F.col("_l").cast("int")).over(W.partitionBy("doc_id").orderBy("ix").rowsBetween(-(reach - 1), 0))
    rows = lines.withColumn("_l", labelled).withColumn("_near", near)
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{2,4}\b"), 0), any_date), lambda d: d.isNotNull())
    per = rows.select("doc_id", "_l", F.when(F.col("_near") == 1, found).otherwise(F.array().cast("array<string>")).alias("d"))
    return per.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("d")))).alias("dates"), F.max("_l").alias("labelled"))
