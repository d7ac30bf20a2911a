"""Kinds of pages and documents: headings, weighted signs, damping, continuation pages, and what a document is as a whole.

Every score is made within the page's row, so classifying needs no shuffle; continuation and documents need one by doc_id. Phrases and
points are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.judgements import any_of, ladder, leads
from ..functions.text import ascii_fold, fold_spaces, let, squeezed

#: Headings that begin a line, in the order in which they are tried.
HEADINGS = {
    "order_cancellation": ("demande d'annulation d'une commande", "demande d annulation d une commande", "annulation de commande", "order cancellation"),
    "approval_form": ("general approval form", "rb general approval form"),
    "generic_document": ("relance retour sans ar", "relance retours sans ar", "relance commande sans ar", "relance commandes sans ar", "relance commande sans a.r.", "relance commandes sans a.r.", "notification de relance d'une commande", "relance accuse de reception", "relance d'accuse de reception", "abandon reliquat", "abandon de reliquat", "annulation reliquat", "annulation de reliquat"),
    "order_confirmation": ("confirmation de commande", "confirmation commande", "order confirmation", "auftragsbestatigung"),
    "request_for_quotation": ("demande de prix", "request for quotation", "request for quote", "rfq"),
    "quotation": ("offre de prix", "offre commerciale", "devis", "quotation", "quote", "angebot"),
    "invoice": ("facture", "invoice", "rechnung"),
    "delivery_note": ("bon de livraison", "delivery note", "packing list", "lieferschein"),
    "purchase_order": ("bon de commande", "purchase order", "commande fournisseur", "commande achat", "commande regroupee", "pedido de compra", "bestellung", "c o m m a n d e"),
}
LEGAL_HEADINGS = ("conditions generales", "general terms and conditions", "conditions of purchase", "allgemeine einkaufsbedingungen")
REMITTANCE = ("virement bancaire", "total virement", "date de valeur", "reglement du releve", "libelle date votre ref. notre ref. montant")
#: Terms anywhere in a page's folded text, and the points that each gives.
ORDER_TERMS = {
    "purchase order": 7.0, "bon de commande": 7.0, "commande regroupee": 8.0, "commande fournisseur": 7.0, "commande achat": 7.0, "pedido de compra": 7.0, "bestellung": 5.0, "no commande": 5.0, "commande no": 5.0, "po number": 5.0, "po no": 4.0,
}
ORDER_HEADERS = ("code article", "libelle", "designation", "commande", "quantite", "quantity", "pu h.t", "pu ht", "unit price", "prix unitaire", "adresse de livraison", "reference fournisseur", "sem/ann", "delai", "montant", "net h.t", "total h.t", "total ht", "net a payer", "grand total")
TABLE_HEADERS = ("designation", "reference fournisseur", "quantite", "sem/ann", "montant", "net h.t")
CONFIRMATION_TERMS = {"confirmation de commande": 7.0, "confirmation commande": 7.0, "order confirmation": 7.0, "auftragsbestatigung": 7.0}
LEGAL_TERMS = {"conditions generales d'achat": 10.0, "general terms and conditions": 9.0, "conditions of purchase": 8.0, "allgemeine einkaufsbedingungen": 9.0, "conditions generales": 4.0}
LEGAL_WORDS = ("acquereur", "fournisseur", "resiliation", "propriete intellectuelle", "confidentialite", "responsabilite", "litiges", "droit applicable", "penalites de retard", "protection des donnees")
#: As above, for terms that must stand as whole words.
WORD_TERMS = {
    "order_cancellation": {"demande d'annulation d'une commande": 10.0, "annulation de commande": 8.0, "order cancellation": 8.0},
    "remittance_advice": {"remittance advice": 10.0, "avis de virement": 9.0, "total virement": 5.0, "date de valeur": 3.0},
    "approval_form": {"rb general approval form": 9.0, "general approval form": 7.0, "approval workflow": 4.0, "approver(s)": 2.0},
    "invoice": {"facture": 4.0, "invoice": 4.0, "amount due": 2.0, "total ttc": 2.0},
    "delivery_note": {"bon de livraison": 6.0, "delivery note": 6.0, "packing list": 4.0},
    "request_for_quotation": {"demande de prix": 7.0, "request for quotation": 7.0, "request for quote": 7.0, "rfq": 5.0},
    "quotation": {"devis": 5.0, "quotation": 5.0, "quote": 3.0, "angebot": 4.0},
    "contract": {"contrat": 3.0, "contract": 3.0, "agreement": 3.0, "vertrag": 3.0},
}
#: Kinds in the order that decides ties.
KINDS = ("order_cancellation", "remittance_advice", "approval_form", "order_confirmation", "purchase_order", "legal_terms", "invoice", "delivery_note", "request_for_quotation", "quotation", "contract", "generic_document")
PRIORITY = ("order_cancellation", "remittance_advice", "order_confirmation", "purchase_order", "invoice", "delivery_note", "request_for_quotation", "quotation")
#: Signs of a document without pages: terms, and how many must be there.
SIGNATURES = {
    "order_cancellation": (("demande d'annulation d'une commande", "annulation de commande", "order cancellation"), 1), "remittance_advice": (("remittance advice", "avis de virement", "total virement", "date de valeur"), 2),
    "approval_form": (("rb general approval form", "general approval form", "approver(s)", "approval workflow"), 1), "invoice": (("invoice", "facture", "rechnung", "invoice number", "total ttc", "amount due"), 2),
    "delivery_note": (("delivery note", "bon de livraison", "lieferschein", "packing list"), 1), "request_for_quotation": (("demande de prix", "request for quotation", "request for quote", "rfq"), 1),
    "quotation": (("quotation", "quote", "devis", "angebot"), 1), "contract": (("contract", "contrat", "vertrag", "agreement"), 2), "email": (("subject:", "from:", "to:", "message-id:"), 2),
}
STRONG_ORDER = ("purchase order", "bon de commande", "commande fournisseur", "commande achat", "pedido de compra", "bestellung")
WEAK_ORDER = ("po number", "po no", "order date", "customer reference", "supplier", "material", "qty", "grand total")
VOCABULARY = {
    "fr": ("commande", "fournisseur", "acheteur", "livraison", "désignation", "quantite", "quantité", "prix", "paiement", "tva"), "de": ("bestellung", "lieferant", "lieferung", "menge", "preis", "zahlung", "rechnung"),
    "en": ("purchase order", "supplier", "buyer", "delivery", "quantity", "price", "payment"), "es": ("pedido", "proveedor", "entrega", "cantidad", "precio", "pago"), "it": ("ordine", "fornitore", "consegna", "quantità", "prezzo", "pagamento"),
}
LINE_HEADERS = ("lig", "ligne", "produit", "article", "qte", "quantite", "prix unitaire", "montant", "date de livraison", "designation", "reference fournisseur")


def count_in(low: Column, terms) -> Column:
    """How many of the terms the text holds."""
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def points(low: Column, terms: dict[str, float]) -> Column:
    return sum((F.when(F.contains(low, F.lit(t)), w).otherwise(0.0) for t, w in terms.items()), F.lit(0.0))


def word_points(low: Column, terms: dict[str, float]) -> Column:
    quoted = lambda t: "(?<![\\w])\\Q" + t + "\\E(?![\\w])"
    return sum((F.when(low.rlike(quoted(t)), w).otherwise(0.0) for t, w in terms.items()), F.lit(0.0))


def line_title(line: Column) -> Column:
    """The kind that a line announces as a heading; ``stop`` for legal terms; null if it announces nothing."""

    def judge(v: Column) -> Column:
        plain, low = v["plain"], v["low"]
        link = low.rlike(r"\bwww\.|https?://")
        number = low.rlike("^commande (no?|num|numero|number|#)[ .:0-9]") | low.rlike("^commande no?$")
        routed = leads(low, ("facture a", "devis valable", "devis complementaire"))
        starts = [((leads(low, phrases) | (number if kind == "purchase_order" else F.lit(False))) & ~routed, kind) for kind, phrases in HEADINGS.items()]
        ends = plain.rlike(r"\b(COMMANDE FOURNISSEUR|COMMANDE ACHAT|BON DE COMMANDE|PURCHASE ORDER)$") | F.contains(low, F.lit("commande regroupee"))
        numbered = F.regexp_extract(low, r"^(.*?)\bcommande n(?:o|umero)?[^a-z0-9]{0,3}[a-z0-9][a-z0-9._/-]{3,}", 1)
        inline = low.rlike(r"\bcommande n(o|umero)?[^a-z0-9]{0,3}[a-z0-9][a-z0-9._/-]{3,}") & ~F.endswith(numbered, F.lit("bon de "))
        mixed = low.rlike(r"(?<!bon de )\bcommande\b.{0,40}\bn(o|umero)?\b") & low.rlike(r"\b[0-9]{4,}\b") & ~low.rlike(r"\b(confirmation|annulation|relance|accuse de reception)\b")
        price = low.rlike(r"\bdemande de( page)? prix\b")
        rest = low.rlike(r"\b(abandon|annulation) (de )?reliquat$")
        return ladder((low == "", None), (leads(low, LEGAL_HEADINGS) & ~link, "stop"), (leads(low, LEGAL_HEADINGS), None), *starts, (ends | inline | mixed, "purchase_order"), (price, "request_for_quotation"), (rest, "generic_document"))

    return let(squeezed(ascii_fold(line)), lambda p: let(F.struct(p.alias("plain"), F.lower(p).alias("low")), judge))


def title(text: Column) -> Column:
    """The kind that a page's head announces: of a remittance or a cancellation by its phrases, else by the first heading among its lines."""
    raw = F.coalesce(text, F.lit(""))
    start, head = F.substr(raw, F.lit(1), F.lit(12000)), F.substr(raw, F.lit(1), F.lit(1800))

    def whole(v: Column) -> Column:
        page, entries = v["page"], F.regexp_count(v["lines"], F.lit(r"(?m)^\s*(factf|avoif)\b"))
        remitted = any_of(page, ("remittance advice", "avis de virement")) | (count_in(page, REMITTANCE) >= 3) | (F.contains(page, F.lit("total virement")) & F.contains(page, F.lit("date de valeur")) & (entries >= 2))
        return F.when(remitted, "remittance_advice").when(any_of(v["head"], HEADINGS["order_cancellation"]), "order_cancellation")

    kinds = F.array_compact(F.transform(F.split(head, r"\r?\n"), line_title))
    of_page = let(F.struct(fold_spaces(start).alias("page"), F.lower(ascii_fold(start)).alias("lines"), fold_spaces(head).alias("head")), whole)
    return F.coalesce(of_page, F.nullif(F.get(kinds, F.lit(0)), F.lit("stop")))


def classify(pages: DataFrame) -> DataFrame:
    """Adds kind, confidence and title to pages (doc_id, page, text)."""
    c = F.col
    rows = pages.withColumns({"title": title(c("text")), "_low": fold_spaces(c("text")), "_lines": F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), fold_spaces)})
    low = c("_low")
    headers = count_in(low, ORDER_HEADERS)
    item = low.rlike(r"\b[a-z]{0,4} ?[0-9]{6,14}\b") & any_of(low, ("pu h.t", "quantity", "commande", "code article"))
    order = points(low, ORDER_TERMS) + F.least(F.lit(8.5), headers * 1.15) + F.when(count_in(low, TABLE_HEADERS) >= 4, 4.0).otherwise(0.0) + F.when(F.substr(low, F.lit(1), F.lit(1800)).rlike(r"\bcommande\b"), 1.2).otherwise(0.0) + F.when(item, 1.2).otherwise(0.0)
    headed = F.exists("_lines", lambda line: leads(line, LEGAL_HEADINGS) & ~line.rlike(r"\bwww\.|https?://"))
    clause = F.filter("_lines", lambda line: line.rlike(r"^[0-9]{1,2}(\.[0-9]{1,2}){0,3} +[a-z]") & (F.regexp_extract(line, "^([0-9]{1,2})", 1).cast("int") <= 20))
    clauses, words = F.array_size(clause), count_in(low, LEGAL_WORDS)
    legal_points = sum((F.when(F.contains(low, F.lit(t)), F.when(c("_headed"), w).otherwise(min(w, 1.5))).otherwise(0.0) for t, w in LEGAL_TERMS.items()), F.lit(0.0))
    rows = rows.withColumns({"_headed": headed, "_clauses": clauses})
    legal = legal_points + F.when(c("_clauses") >= 4, F.least(F.lit(7.0), 1.0 + c("_clauses") * 0.35)).otherwise(0.0) + F.when(words >= 3, F.least(F.lit(5.0), words * 0.75)).otherwise(0.0)
    scores = {"order_confirmation": points(low, CONFIRMATION_TERMS), "purchase_order": order, "legal_terms": legal, "generic_document": F.lit(0.25), **{k: word_points(low, t) for k, t in WORD_TERMS.items()}}
    titled = lambda k, s: s + F.when(c("title") == k, 12.0).otherwise(0.0)
    rows = rows.withColumns({f"_{k}": titled(k, scores[k]) for k in KINDS})
    table = low.rlike(r"\b(quantite|quantity|qte|qty)\b") & low.rlike(r"\b(designation|description|reference|code article)\b") & low.rlike(r"\b(prix|price|montant|amount|pu)\b")
    damped = F.when(c("title").isNotNull() & (c("title") != "purchase_order"), 0.25).when(c("title").isNull() & (c("_legal_terms") >= 3) & ~table, 0.25).otherwise(1.0)
    rows = rows.withColumn("_purchase_order", c("_purchase_order") * damped)
    rows = rows.withColumn("_purchase_order", F.when((c("_legal_terms") >= 8) & (c("_purchase_order") < 9), c("_purchase_order") * 0.35).otherwise(c("_purchase_order")))
    rows = rows.withColumn("_contract", F.when((c("_purchase_order") >= 8) & (c("_legal_terms") < 8), c("_contract") * 0.5).otherwise(c("_contract")))
    ranked = F.sort_array(F.array(*(F.struct(c(f"_{k}").alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS))), asc=False)
    rows = rows.withColumn("_ranked", F.slice(ranked, 1, 2))
    top, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))["score"]
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top["score"] - second) / F.greatest(top["score"], F.lit(1.0))))
    value = F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.995), 0.62 * F.least(F.lit(1.0), top["score"] / 10) + 0.38 * margin)), 4)
    weak = top["score"] < 1.5
    return rows.select(*pages.columns, "title", F.when(weak, "generic_document").otherwise(top["kind"]).alias("kind"), F.when(weak, 0.45).otherwise(value).alias("confidence"))


def in_documents(pages: DataFrame) -> DataFrame:
    """Untitled order pages of a document whose only title says otherwise take that kind, with a confidence of 0.84 at most."""
    only = W.partitionBy("doc_id")
    rows = pages.withColumns({"_first": F.min("title").over(only), "_last": F.max("title").over(only)})
    other = (F.col("_first") == F.col("_last")) & (F.col("_first") != "purchase_order") & F.col("title").isNull() & (F.col("kind") == "purchase_order")
    out = rows.withColumns({"kind": F.when(other, F.col("_first")).otherwise(F.col("kind")), "confidence": F.when(other, F.least("confidence", F.lit(0.84))).otherwise(F.col("confidence"))})
    return out.drop("_first", "_last")


def continuation_evidence(text: Column, headers: Column) -> tuple[Column, Column]:
    """Whether a page goes on with an order: strong evidence (its table's headers, or products with prices), and weak (the order's number beside a page count)."""
    folded = F.transform(F.coalesce(headers, F.array().cast("array<string>")), fold_spaces)
    hits = let(folded, lambda h: sum((F.exists(h, _holds(t)).cast("int") for t in LINE_HEADERS), F.lit(0)))
    products = (F.regexp_count(text, F.lit(r"\[[0-9]{10,11}\]")) >= 2) & (F.regexp_count(text, F.lit(r"\b[0-9][0-9 .]*,[0-9]{2}\s*€")) >= 2)
    top = lambda t: t.rlike(r"\b(cde|commande|purchase order)\b.{0,80}(\b(no?|number)\b|#).{0,80}[0-9]{5,}") & t.rlike(r"\bpage [0-9]+ (sur|of) [0-9]+\b")
    numbered = let(fold_spaces(F.substr(F.coalesce(text, F.lit("")), F.lit(1), F.lit(1200))), top)
    return F.coalesce((hits >= 4) | products, F.lit(False)), F.coalesce(numbered, F.lit(False))


def _holds(term: str):
    return lambda text: F.contains(text, F.lit(term))


def promote(pages: DataFrame) -> DataFrame:
    """Pages that follow an order page one by one, each with evidence, become order pages: a run of such pages after the first order page in it.

    ``pages`` has kind, confidence, text and ``headers`` (array of a table's headers, or null).
    """
    strong, weak = continuation_evidence(F.col("text"), F.col("headers"))
    order = W.partitionBy("doc_id").orderBy("page")
    rows = pages.withColumns({"_po": F.col("kind") == "purchase_order", "_strong": strong, "_weak": weak}).withColumn("_may", F.col("_po") | F.col("_strong") | F.col("_weak"))
    new = ~(F.coalesce(F.lag("_may").over(order), F.lit(False)) & (F.col("page") - F.lag("page").over(order) == 1))
    rows = rows.withColumn("_run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order))
    earlier = F.max(F.col("_po").cast("int")).over(W.partitionBy("doc_id", "_run").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    joined = ~F.col("_po") & F.col("_may") & (F.coalesce(earlier, F.lit(0)) == 1)
    least = F.when(F.col("_strong"), 0.84).otherwise(0.79)
    out = rows.withColumns({"promoted": joined, "kind": F.when(joined, "purchase_order").otherwise(F.col("kind")), "confidence": F.when(joined, F.round(F.greatest("confidence", least), 4)).otherwise(F.col("confidence"))})
    return out.drop("_po", "_strong", "_weak", "_may", "_run")


def documents(pages: DataFrame) -> DataFrame:
    """Each document's primary kind, whether it holds several, what it is called then, and its confidence. One shuffle by (doc_id, kind), then doc_id."""
    titled = F.col("title") == F.col("kind")
    per = pages.groupBy("doc_id", "kind").agg(F.sum("confidence").alias("total"), F.avg("confidence").alias("mean"), F.avg(F.when(titled, F.col("confidence"))).alias("mean_titled"), F.min("page").alias("first"))
    rank = F.when(F.col("kind").isin(*PRIORITY), F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind"))).otherwise(99)
    best = F.min(F.struct(rank.alias("rank"), (-F.round("total", 9)).alias("less"), "first", "kind", F.coalesce("mean_titled", "mean").alias("confidence"))).alias("b")
    out = per.groupBy("doc_id").agg(best, F.count_if(F.col("kind") != "generic_document").alias("kinds"), F.max((F.col("kind") == "legal_terms").cast("int")).alias("legal"))
    primary, several = F.col("b.kind"), F.col("kinds") > 1
    detected = ladder(((primary == "purchase_order") & (F.col("legal") == 1), "purchase_order_with_terms"), ((primary == "purchase_order") & several, "purchase_order_bundle"), otherwise=primary)
    return out.select("doc_id", primary.alias("primary"), detected.alias("detected"), several.alias("is_composite"), F.round("b.confidence", 4).alias("confidence"))


def document_type(text: Column, family: Column) -> Column:
    """The kind of a text without pages: its title, a strong phrase, four weak signs of orders, the signature with most hits, or its family's."""
    families = {"spreadsheet": "spreadsheet", "presentation": "presentation", "word": "text_document"}

    def judge(low: Column) -> Column:
        hits = F.array(*(F.struct(F.when(count_in(low, terms) >= least, count_in(low, terms)).otherwise(0).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, (terms, least)) in enumerate(SIGNATURES.items())))
        best = F.array_max(hits)
        return F.when(any_of(low, STRONG_ORDER) | (count_in(low, WEAK_ORDER) >= 4), "purchase_order").when(best["n"] > 0, best["kind"])

    return F.coalesce(title(text), let(F.lower(squeezed(text)), judge), F.element_at(F.create_map(*(F.lit(x) for kv in families.items() for x in kv)), family), F.lit("generic_document"))


def languages(text: Column) -> Column:
    """Up to three languages with two or more words of their list, most first."""
    counts = lambda low: F.array(*(F.struct(count_in(low, [f" {t} " for t in terms]).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("language")) for i, (k, terms) in enumerate(VOCABULARY.items())))
    scored = let(F.concat(F.lit(" "), F.lower(squeezed(text)), F.lit(" ")), counts)
    return F.transform(F.slice(F.filter(F.sort_array(scored, asc=False), lambda s: s["n"] >= 2), 1, 3), lambda s: s["language"])


def transactional_quality(source: Column, routing: Column, order: Column, status: Column, completeness: Column, family: Column | None = None, weight: float = 0.0) -> Column:
    """Weighted quality of an order's extraction from its parts; the validation's status counts 1, 0.72, 0.25 or 0.5."""
    checked = ladder((status == "PASS", 1.0), (status == "WARNING", 0.72), (status == "FAIL", 0.25), otherwise=0.5)
    known = family if family is not None else F.lit(0.0)
    return (0.22 - weight / 2) * source + 0.18 * routing + 0.30 * order + 0.18 * checked + (0.12 - weight / 2) * completeness + weight * known


def generic_quality(source: Column, text: Column, tables: Column, pairs: Column) -> Column:
    """Quality of a document that is no order: of its source and text, and whether it has tables and labelled values."""
    return 0.65 * source + 0.20 * text + 0.10 * F.least(F.lit(1.0), tables / 3) + 0.05 * F.least(F.lit(1.0), pairs / 10)
