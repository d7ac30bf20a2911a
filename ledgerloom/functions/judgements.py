"""What a printed text can be: names of parties, order numbers, addresses, people, charges, codes. All are column expressions.

Word lists and weights are fixed values; a verdict is the first rule of a list that holds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, fold_spaces, identifier, let, name_key, squeezed, upper_key, upper_words

#: Words of streets, zones and routing.
STREETS = ("rue", "avenue", "route", "boulevard", "chemin", "impasse")
ZONES = ("zac", "zae", "zi", "z.i.")
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
#: Words that show a text to be something else than an order number, or than a party's name.
NOT_NUMBERS = ("code fournisseur", "supplier code", "vendor code", "telephone", "tel ", "fax", "telecopie", "tva", "siret", "iban", "total", "poids", "volume")
LABELS = ("telephone", "fax", "telecopie", "code fournisseur", "date", "reference", "produit fini", "mode livraison")
PHRASES = ("retourner sous", "merci de livrer", "suivant offre", "franco", "adresse de livraison", "a facturer", "a livrer", "bon de commande", "commande n", "total ht", "net a payer")
INSTRUCTIONS = ("retourner sous", "merci de livrer", "suivant offre", "franco", "date de livraison", "a facturer", "a livrer", "adresse de livraison", "commande n", "bon de commande", "conditions de paiement", "mode livraison", "total ht", "net a payer", "contact :")
TRADES = ("sas", "sarl", "sa ", "sasu", "groupe", "holding", "distribution", "energie", "chauffage", "leblanc", "bosch", "ccl", "iserba", "regmatherm", "unicia")
WEAK_WORDS = ("tel", "fax", "mail", "adresse", "commande", "purchase order", "page", "virement", "reglement", "rglt", "sem/ann", "montant", "quantite", "capital", "siret", "rcs", "tva", "iban", "bic")
LEGAL_FORMS = ("sas", "sasu", "sa", "sarl", "gmbh", "ltd", "llc", "inc", "ag", "spa", "s.a.")
CAPTIONS = ("n° commande", "no commande", "date n°", "code article", "total h.t", "conditions generales", "code fournisseur", "facture a", "adresse de livraison", "produit fini", "mode livraison")
LEGAL_TERMS = ("siren", "siret", "rcs", "iban", "bic", "capital de", "capital social", "no intracom", "tva intracom", "ape", "naf")
ORDER_SIGNALS = ("purchase order", "bon de commande", "commande fournisseur", "commande achat", "bestellung", "pedido de compra", "order date", "fournisseur", "supplier")
PERSON_EXCLUDES = ("SAS", "SARL", "SA", "SOCIETE", "GROUPE", "HOLDING", "DEPOT", "AGENCE", "CCL", "PPC", "ISERBA", "REXEL", "PROLIANS")
ORGANISATION = ("SAS", "SARL", "SOCIETE", "GROUPE", "HOLDING", "DEPOT", "AGENCE", "CCL", "PPC", "ISERBA", "REXEL", "PROLIANS", "LOGISTIQUE", "CHAUFFAGE", "SANITAIRE")
SAFE_EXCLUDES = ("CONDITIONS DE LIVRAISON", "CONDITIONS DE PAIEMENT", "N INTERNE", "SIEGE SOCIAL", "ARTICLE", "POMPE", "CHAUDIERE", "BRULEUR", "PRIX", "TOTAL", "PORT", "TVA", "SIREN", "SIRET", "IBAN")
SUSPECT = ("CONDITIONS DE LIVRAISON", "CONDITIONS DE PAIEMENT", "SIEGE SOCIAL", "PAS DE LIVRAISON", "LIVRE FORFAIT", "ADHERENT ALGOREL")
PRODUCTS = ("POMPE", "CHAUDIERE", "BRULEUR", "ARTICLE", "PORT", "PRIX")
STOP_CODES = ("ADRESSE", "AGENCE", "ATTN", "BAT", "BATIMENT", "BP", "CEDEX", "CENTRE", "CLIENT", "CODE", "CS", "DEPOT", "DESTINATAIRE", "FR", "FRANCE", "LIVRAISON", "DE", "DU", "LA", "LE", "LES", "MAGASIN", "PORT", "QUAI", "RUE", "SITE", "TSA", "ZA", "ZAC", "ZAE", "ZI")
NO_REFERENCES = ("DEVIS", "OFFRE", "PRIX", "NUMERO", "REFERENCE", "REF", "PAGE", "EUR", "EURO", "HT", "TTC", "TVA")
SEPARATORS = ("-", "/", ".", ":", "#", "%", "€", "$", "£", "¥", "°")
ITEM_EXCLUDES = ("N/REF", "TOTAL", "PAIEMENT", "ACOMPTE")


def _either(terms: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(t).replace("\\ ", " ") for t in terms) + ")"


def any_of(x: Column, terms: Sequence[str]) -> Column:
    """Whether the text holds one of the terms anywhere."""
    return x.rlike(_either(terms))


def may_hold(x: Column, words: Sequence[str]) -> Column:
    """False only if the text's folded forms hold none of the words of small ASCII letters and digits: what is ASCII folds letter by letter, all else may."""
    low = F.lower(x)
    return reduce(or_, (F.contains(low, F.lit(w)) for w in words if not any(v in w for v in words if v != w)), F.octet_length(x) != F.length(x))


def words_in(x: Column, terms: Sequence[str]) -> Column:
    """Whether a text of words and single blanks holds one of the terms as whole words."""
    return x.rlike(f"(?:^| ){_either(terms)}(?: |$)")


def forms(x: Column, body) -> Column:
    """``body`` of the squeezed text and its folded form, both made once."""
    return let(F.struct(squeezed(x).alias("text"), fold_spaces(x).alias("low")), lambda v: body(v["text"], v["low"]))


def ladder(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(rules[0][1]) if not isinstance(rules[0][1], Column) else rules[0][1])
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def letters(x: Column) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(x, r"\P{L}+", ""))


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]+", "")


def grouped_phone(x: Column) -> Column:
    """Groups of digits as phones are printed: a country code and two groups or more, or five pairs."""
    groups = F.split(F.regexp_replace(x, r"^\+", ""), "[ .-]")
    size = lambda low, high: F.forall(F.slice(groups, 2, 99), lambda g: g.rlike("^[0-9]+$") & F.length(g).between(low, high))
    head = F.get(groups, F.lit(0))
    abroad = (F.array_size(groups) >= 3) & head.rlike("^[0-9]{1,3}$") & size(2, 4)
    pairs = (F.array_size(groups) >= 5) & ~F.startswith(x, F.lit("+")) & head.rlike("^[0-9]{2}$") & size(2, 2)
    return abroad | pairs


def order_number_type(x: Column) -> Column:
    """Whether a text may be an order number by its kind: no label, phone or address of mail, and only the usual characters."""
    usual = lambda t: F.length(t).between(2, 64) & t.rlike("^[A-Za-z0-9]") & ~t.rlike("[^A-Za-z0-9 ._/-]")
    return forms(x, lambda text, low: usual(text) & ~any_of(low, NOT_NUMBERS) & ~grouped_phone(text))


def only_phone_signs(text: Column) -> Column:
    return (F.length(text) >= 7) & ~text.rlike("[^+0-9 .()/-]")


def leads(low: Column, words: Sequence[str]) -> Column:
    """Whether a folded text begins with one of the words."""
    return low.rlike(f"^{_either(words)}(?: |$)")


def numbered_street(low: Column, words: Sequence[str] = STREETS) -> Column:
    """A house number, then a street's word."""
    return low.rlike(f"^[0-9]+[a-z]? +{_either(words)}(?: |$)")


def postal_first(text: Column, least: int = 5, most: int = 5) -> Column:
    """A postal code, a blank and more."""
    return text.rlike(f"^[0-9]{{{least},{most}}} ") & (F.length(text) > least + 1)


def party_name_quality(x: Column) -> Column:
    """0 to 1: how plausible a text is as the name of a party."""

    def judge(text: Column, low: Column) -> Column:
        n = letters(text)
        full = F.least(F.lit(1.0), 0.55 + n / F.greatest(F.lit(10), F.length(text)) * 0.45)
        return ladder(
            (text == "", 0.0), (F.contains(text, F.lit("@")) | only_phone_signs(text), 0.0), (any_of(low, LABELS), 0.1), (any_of(low, PHRASES), 0.05),
            (leads(low, (*STREETS, *ZONES)), 0.08), (numbered_street(low), 0.15), (postal_first(text), 0.15), (n < 3, 0.2), otherwise=full,
        )

    return forms(x, judge)


def company_name_quality(x: Column) -> Column:
    """0 to 1: as above, with more for words of the trade and less for instructions and addresses."""

    def judge(text: Column, low: Column) -> Column:
        n, streets = letters(text), (*STREETS, "av", "av.", "bd", "bd.")
        full = F.least(F.lit(1.0), 0.50 + n / F.greatest(F.lit(12), F.length(text)) * 0.42 + F.when(any_of(low, TRADES), 0.12).otherwise(0.0))
        return ladder(
            (text == "", 0.0), (F.contains(text, F.lit("@")) | only_phone_signs(text), 0.0), (any_of(low, INSTRUCTIONS), 0.05), (leads(low, (*streets, *ZONES)), 0.08),
            (numbered_street(low, streets), 0.05), (postal_first(text, 4, 6), 0.05), (F.length(text) > 95, 0.25), (n < 3, 0.15), otherwise=full,
        )

    return forms(x, judge)


def party_name_strength(x: Column) -> Column:
    """Points for what names have and against what other texts have; -10 for what can't be a name."""

    def judge(text: Column, low: Column) -> Column:
        n, capitals = letters(text), F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
        padded = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9.]+", " "), F.lit(" "))
        points = (
            F.lit(0.5)
            + F.when(F.array_size(F.split(text, " ")).between(2, 8), 1.0).otherwise(0.0)
            + F.when(capitals / F.greatest(n, F.lit(1)) > 0.72, 1.3).otherwise(0.0)
            + F.when(any_of(padded, [f" {w} " for w in LEGAL_FORMS]), 2.0).otherwise(0.0)
            - F.when(text.rlike("[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"), 4.0).otherwise(0.0)
            - F.when(any_of(low, WEAK_WORDS), 3.0).otherwise(0.0)
            - F.when(any_of(padded, [f" {w} " for w in ("rue", "avenue", "av", "av.", "boulevard", "route", "zi", "z.i.", "bp", "cedex")]), 2.5).otherwise(0.0)
            - F.when(leads(low, ("st", "saint")) & ~low.rlike("[^a-z -]") & F.contains(low, F.lit(" ")), 2.0).otherwise(0.0)
        )
        return F.when((text == "") | (F.length(text) > 90) | (n == 0), -10.0).otherwise(points)

    return forms(x, judge)


def bad_party_name(x: Column) -> Column:
    """Whether a text is a caption, an account, a date, an address or a phone rather than a party's name."""

    def judge(text: Column, low: Column) -> Column:
        words = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
        caption = low.isin("infos fournisseur", "nom adresse", "nom et adresse", "fournisseur")
        account = words.rlike("^(n o |no |n )?(compte( client)?|numero de compte) [0-9]") | low.rlike("^n[o.]? ?[0-9]")
        dated = words.rlike("^date [0-9]{1,2} [0-9]{1,2} [0-9]{2,4}( |$)")
        numbered = leads(low, ("numero",)) & low.rlike("[0-9]")
        row = (F.regexp_count(words, F.lit(r"\b(pce|piece|pcs)\b")) >= 2) & (F.regexp_count(low, F.lit("[0-9][,.][0-9]{2}")) >= 2)
        other = (F.length(low) > 100) | any_of(low, CAPTIONS) | F.contains(text, F.lit("@")) | only_phone_signs(text) | numbered_street(low) | postal_first(text)
        return (low == "") | caption | account | dated | numbered | row | other

    return forms(x, judge)


#: A word of each rule of ``charge_kind`` and ``fee_kind``: a text with none of them names no charge.
FEE_WORDS = ("deee", "d3ee", "weee", "eco", "port", "transport", "livraison", "expedition", "shipping", "freight", "tax", "tgap", "contribution", "surcharge", "supplement", "frais")


def charge_kind(x: Column) -> Column:
    """environmental_fee, shipping, tax or surcharge for a row that names a charge; null for a product."""

    def judge(words: Column) -> Column:
        environment = words.rlike(" (deee|d3ee|weee)[ 0-9]") | words.rlike(" eco ?(parti?cipation|particippation|contribution|mobilier) ")
        carried = "(port|transport|livraison|expedition)"
        shipping = (
            words.rlike(f" (frais|forfait|participation|cout|montant) (de |du )?{carried} ") | words.rlike(" port (standard|express|ht|facture|forfait|fournisseur) ")
            | words.rlike("^ port port ") | words.rlike(" (shipping|freight) ") | words.rlike(f"^ {carried}( ht)? $") | words.rlike(" portstd ") | words.rlike(" port ?/ ?achats? ")
        )
        tax = words.rlike(" (ecotaxe|taxe|tax|tgap|contribution (fiscale|environnementale)) ") & ~words.rlike(" hors taxes? ")
        surcharge = words.rlike(" (surcharge|supplement|frais (de )?(dossier|gestion|manutention|emballage)) ")
        return ladder((environment, "environmental_fee"), (shipping, "shipping"), (tax, "tax"), (surcharge, "surcharge"))

    return F.when(may_hold(x, FEE_WORDS), let(F.concat(F.lit(" "), F.regexp_replace(fold_spaces(x), "[^a-z0-9/]+", " "), F.lit(" ")), judge))


def fee_kind(x: Column) -> Column:
    """As ``charge_kind``; any other mention of a fee is a surcharge."""
    return F.when(may_hold(x, FEE_WORDS), F.coalesce(charge_kind(x), F.when(any_of(fold_spaces(x), ("surcharge", "supplement", "frais")), "surcharge")))


def legal_footer(material: Column, *texts: Column) -> Column:
    """Whether a row is company registration text: a legal term as whole words, or a registration number beside one."""
    low = fold(F.concat_ws(" ", *texts))
    registered = F.coalesce(material, F.lit("")).rlike("^([0-9]{9}|[0-9]{14})$") & any_of(low, ("siren", "siret", "rcs"))
    return words_in(low, LEGAL_TERMS) | registered


def backed_number(number: Column, raw: Column) -> Column:
    """Whether the printed row begins with its own number, then a blank or a closing sign."""
    n, text = F.trim(F.coalesce(number, F.lit(""))), F.ltrim(F.coalesce(raw, F.lit("")))
    after = F.substr(text, F.length(n) + 1, F.lit(1))
    return (n != "") & F.startswith(F.lower(text), F.lower(n)) & after.rlike(r"[\s.)|:-]")


def garbage_token(x: Column, least: int = 1, most: int = 120, share: float = 0.85) -> Column:
    """Whether a read token is noise: too short or long, or nearly all signs; single separators aren't."""
    n, good = F.length(x), F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))
    return ladder(((n < least) | (n > most), True), (x.isin(*SEPARATORS), False), ((good == 0) & (n > 2), True), otherwise=(1 - good / F.greatest(n, F.lit(1))) > share)


def order_context(x: Column) -> Column:
    """Whether a page's text speaks of a purchase order."""
    return any_of(fold_spaces(x), ORDER_SIGNALS)


def date_like(x: Column) -> Column:
    """Day, month and year as digits between slashes, dots or dashes."""
    parts = F.split(x, "[/.-]")
    part = lambda i: F.get(parts, F.lit(i))
    short = lambda c, most: c.rlike("^[0-9]{1,2}$") & (c.cast("int") <= most)
    date = F.coalesce((F.array_size(parts) == 3) & short(part(0), 39) & short(part(1), 12) & part(2).rlike("^([0-9]{2}|[0-9]{4})$"), F.lit(False))
    return F.when(x.rlike("^[0-9]{1,2}[^0-9]"), date).otherwise(False)  # most texts needn't be cut


def item_code(x: Column) -> Column:
    """Whether a token may be an article's code: 4 to 40 usual signs with a digit, and a letter or six digits; no date, no caption."""
    def judge(t: Column) -> Column:
        enough = t.rlike(r"\p{L}") | (F.length(digits(t)) >= 6)
        return F.length(t).between(4, 40) & ~F.upper(t).isin(*ITEM_EXCLUDES) & ~date_like(t) & t.rlike("[0-9]") & enough & ~t.rlike("[^A-Za-z0-9._/-]")

    return let(F.btrim(x, F.lit("[](){}:;,. |")), judge)


def reference_cell(x: Column) -> Column:
    """Struct (reference, description) of a cell whose code and description ran together; grouped digits (7 to 13) are one code."""
    none = F.lit(None).cast("string")
    pair = lambda a, b: F.struct(a.alias("reference"), b.alias("description"))

    def split(v: Column) -> Column:
        parts, at = v["parts"], v["at"]
        joined = F.array_join(parts, "")
        grouped = F.array_size(parts).between(2, 5) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,4}$")) & F.length(joined).between(7, 13)
        code = F.btrim(F.get(parts, at - 1), F.lit("[](){}:;,. |"))
        rest = F.array_join(F.filter(parts, lambda p, i: i != at - 1), " ")
        return F.when(v["text"] == "", pair(none, none)).when(grouped, pair(joined, none)).when(at == 0, pair(none, v["text"])).otherwise(pair(code, F.nullif(rest, F.lit(""))))

    placed = lambda text: let(F.split(text, " "), lambda parts: F.struct(text.alias("text"), parts.alias("parts"), F.array_position(F.transform(parts, item_code), F.lit(True)).cast("int").alias("at")))
    return let(let(squeezed(x), placed), split)


def valid_reference(x: Column) -> Column:
    """3 to 50 characters with a digit that are neither a caption nor a date."""
    v = F.btrim(F.coalesce(x, F.lit("")), F.lit(" .,:;#-/"))
    return ~v.isin(*NO_REFERENCES) & v.rlike(r"\p{Nd}") & ~v.rlike("^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$") & F.length(v).between(3, 50)


def valid_code(x: Column, explicit: bool = False, corroborated: bool = False, customer: bool = False) -> Column:
    """Whether a token may be an agency's code. Digits alone need a label or other evidence, and no more than 7 of them (12 of a customer's)."""
    code = F.upper(F.regexp_replace(F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t,;:#()[]{}")), r"\s+", ""))
    shaped = F.length(code).between(2, 20) & ~code.rlike("[^A-Z0-9._/-]") & code.rlike("^[A-Z0-9]") & code.rlike("[A-Z0-9]$") & ~upper_words(code).isin(*STOP_CODES)
    number = F.lit(explicit or corroborated or customer) & (F.length(code) <= (12 if customer else 7))
    return shaped & F.when(code.rlike("^[0-9]+$"), number).otherwise(F.lit(explicit) | code.rlike("[A-Z]"))


def person_like(x: Column) -> Column:
    """Two to five words without a digit or a word of organisations."""
    words = F.regexp_extract_all(squeezed(x), F.lit("[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’-]*"), 0)
    return F.array_size(words).between(2, 5) & ~squeezed(x).rlike(r"\p{Nd}") & ~F.exists(words, lambda w: name_key(w).isin(*PERSON_EXCLUDES))


def organisation_like(x: Column) -> Column:
    return any_of(name_key(x), ORGANISATION)


def same_party(a: Column, b: Column) -> Column:
    """Whether one name's key holds the other's: six characters or more, or a short brand (fixed values)."""
    x, y = name_key(a), name_key(b)
    shorter = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    held = F.contains(x, y) | F.contains(y, x)
    brands = F.array(*(F.lit(w) for w in ("LEBLANC", "BOSCH")))
    words = lambda c: F.transform(F.split(squeezed(c), " "), name_key)
    branded = F.array_size(F.array_intersect(F.array_intersect(words(a), words(b)), brands)) > 0
    return (x != "") & (y != "") & ((held & ((F.length(shorter) >= 6) | shorter.isin("ELM", "BOSCH"))) | branded)


def street_like(x: Column) -> Column:
    """Whether a text begins as a street: its word, or a house number and its word."""
    low = F.lower(upper_words(x))
    named = ("rue", "avenue", "route", "boulevard", "chemin", "impasse", "allee", "allees", "quai", "traverse")
    return leads(low, named) | numbered_street(low, (*named, "r", "av", "rte", "bd"))


def redundant_department(department: Column, sites: Column) -> Column:
    """Whether a department is two or more parts joined by slashes that are all known parts of the site."""
    parts = F.filter(F.transform(F.split(F.coalesce(department, F.lit("")), "/"), lambda p: upper_words(p)), lambda p: p != "")
    known = F.filter(F.transform(sites, lambda s: upper_words(s)), lambda s: s != "")
    return (F.array_size(known) >= 2) & (F.array_size(parts) >= 2) & (F.array_size(F.array_except(parts, known)) == 0)


def source_contains(value: Column, source: Column) -> Column:
    """Whether a source prints an identifier whatever its spacing, and not as a piece of a longer one."""
    v = identifier(value)
    inner = F.array_join(F.transform(F.split(v, ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), "\\s*")
    pattern = F.concat(F.lit(r"(?<![A-Z0-9])(?<![A-Z0-9][._/-]{1,9})"), inner, F.lit(r"(?![A-Z0-9])(?![._/-]+[A-Z0-9])"))
    return F.coalesce((v != "") & (F.length(v) <= 128) & F.regexp_like(F.upper(source), pattern), F.lit(False))


def source_lost_separator(value: Column, source: Column) -> Column:
    """Whether a source prints an identifier of two and ten digits without the hyphen between them."""
    v = identifier(value)
    return F.coalesce(v.rlike("^[0-9]{2}-[0-9]{10}$") & (F.replace(v, F.lit("-"), F.lit("")) == identifier(source)), F.lit(False))


def location_valid(page: Column, box: Column) -> Column:
    """A page from 1 and a box of four finite numbers, not negative, with an inside."""
    at = lambda i: F.get(box, F.lit(i))
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((page > 0) & (F.array_size(box) == 4) & finite & (at(0) >= 0) & (at(1) >= 0) & (at(2) > at(0)) & (at(3) > at(1)), F.lit(False))


def prose(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-zÀ-ÿ]{2,}")) >= 4


def dated_in_words(low: Column) -> Column:
    """A month's name beside a word that leads a date."""
    return words_in(low, MONTHS) & words_in(low, ("le", "du", "au", "reprise", "fermeture"))


def corroborating(x: Column) -> Column:
    """Whether a candidate may speak for an order number: no amount, date or prose, five signs and two digits."""
    text, v = squeezed(x), identifier(x)
    bare = F.trim(F.regexp_replace(text, "(?i)(€|EUROS?|EUR)$", ""))
    amount = F.regexp_replace(bare, "[ .  ](?=[0-9]{3})", "").rlike(r"^[+-]?[0-9]+[,.][0-9]{2}$")
    day = text.rlike("^([0-9]{1,2}[/.-]){2}[0-9]{2,4}$") | text.rlike("^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$")
    return (F.length(v) >= 5) & (F.length(digits(v)) >= 2) & ~amount & ~day & ~dated_in_words(fold(x)) & ~prose(text)


def order_candidate(x: Column) -> Column:
    """Whether a candidate may be an order number: five signs and four digits, no date, street or prose."""
    key, words = upper_key(x), upper_words(x)
    street = words_in(words, ("RUE", "AVENUE", "BOULEVARD", "ROUTE", "CHEMIN", "IMPASSE", "CEDEX"))
    day = F.trim(F.coalesce(x, F.lit(""))).rlike("^([0-9]{1,2}[/.-]){2}[0-9]{2,4}$")
    return (F.length(key) >= 5) & (F.length(digits(key)) >= 4) & ~day & ~street & ~dated_in_words(F.lower(words)) & ~prose(words)


def contact_number(text: Column, value: Column) -> Column:
    """Whether a text's line prints the digits of a value (8 to 15) after a label of phones or faxes."""
    d = digits(value)
    after = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: digits(F.regexp_extract(upper_words(line), r"\b(?:TELEPHONE|TEL|TELECOPIE|FAX)\b(.*)$", 1)))
    return F.length(d).between(8, 15) & F.exists(after, lambda a: F.contains(a, d))


def postal_codes(x: Column) -> Column:
    """The distinct postal codes of the country (01 to 98) in a text."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?<!\d)(?:0[1-9]|[1-8]\d|9[0-8])\d{3}(?!\d)"), 0))


def crosses_columns(*texts: Column) -> Column:
    """Whether a candidate's texts name two localities once numbers of post boxes are left out: two columns were mixed."""
    words = F.regexp_replace(upper_words(F.concat_ws(" | ", *texts)), r"\b(B ?P|C ?S|T ?S ?A) [0-9]{3,6}\b", " ")
    return F.array_size(postal_codes(words)) > 1


def repeated_name(x: Column) -> Column:
    """Whether a name is the same words twice."""
    words = F.split(upper_words(x), " ")
    n = F.array_size(words)
    return (upper_words(x) != "") & (n >= 2) & (n % 2 == 0) & (F.slice(words, F.lit(1), F.floor(n / 2).cast("int")) == F.slice(words, F.floor(n / 2).cast("int") + 1, F.floor(n / 2).cast("int")))


def name_is_address(x: Column) -> Column:
    """Whether a party's name is a zone, an instruction or a numbered street."""
    words = upper_words(x)
    low = F.lower(words)
    street = words_in(words, ("RUE", "ROUTE", "AV", "AVENUE", "BOULEVARD", "BD", "CHEMIN", "IMPASSE", "ALLEE", "PLACE", "QUAI"))
    return leads(low, ("zi", "za", "zac", "zae", "zone", "parc")) | leads(low, ("par mail", "merci de", "votre accuse", "contact", "livraison", "adresse")) | (words.rlike(r"\b[0-9]{1,4}\b") & street)


def suspicious_delivery(party_name: Column, complement: Column, *texts: Column) -> Column:
    """Whether a delivery block mixes localities, a doubled name, products or legal text."""
    whole, extra = F.concat_ws(" | ", *texts, complement), upper_words(complement)
    product = F.contains(extra, F.lit("N INTERNE")) | (extra.rlike(r"\b[0-9]{8,14}\b") & any_of(extra, PRODUCTS))
    return (F.array_size(postal_codes(whole)) > 1) | repeated_name(party_name) | product | any_of(upper_words(whole), SUSPECT)


def safe_complement(x: Column) -> Column:
    """Whether a short complement of a site may be kept: no postal code, long number or word of products and conditions."""
    text = squeezed(x)
    return (text != "") & (F.length(text) <= 80) & (F.array_size(postal_codes(text)) == 0) & ~text.rlike(r"\b[0-9]{8,14}\b") & ~any_of(upper_words(x), SAFE_EXCLUDES)


def complete_delivery(postal_code: Column, city: Column, site: Column, party_name: Column, confidence: Column) -> Column:
    """A delivery candidate with postal code and city, a site or a name, and a confidence of 0.97."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return there(postal_code) & there(city) & (there(site) | there(party_name)) & (F.coalesce(confidence, F.lit(0.0)) >= 0.97)


def path_in_scope(path: Column, scope: Column) -> Column:
    """Whether a path is in a scope: an equal rule, one that ends in ``.*`` before it, or one whose ``[*]`` stands for any index; all, if there are no rules."""

    def fits(rule: Column) -> Column:
        below = F.endswith(rule, F.lit(".*")) & F.startswith(path, F.substr(rule, F.lit(1), F.length(rule) - 1))
        return (rule == path) | below | (F.contains(rule, F.lit("[*]")) & (F.regexp_replace(path, r"\[[0-9]+\]", "[*]") == F.regexp_replace(rule, r"\[[0-9]+\]", "[*]")))

    return (F.array_size(scope) == 0) | F.exists(scope, fits)


def line_item_field(label: Column, path: Column) -> Column:
    """Whether an annotated field belongs to the repeated rows of a table."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.startswith(F.upper(F.trim(F.coalesce(label, F.lit("")))), F.lit("LINE_ITEM_")) | F.contains(low, F.lit("line_items[")) | F.contains(low, F.lit("lines["))


def address_line(x: Column) -> Column:
    """Whether a line looks postal: a code before or after its place, a street, a zone, post boxes or a building in front."""

    def judge(text: Column, low: Column) -> Column:
        words = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9.]+", " "), F.lit(" "))
        named = words.rlike(r" (rue|avenue|boulevard|route|chemin|impasse|allee|zac|zae|zone|zi|z\.?i\.?|tsa|b\.?p\.?|c\.?s\.?|cedex) ")
        return low.rlike(r"^[a-z][a-z '.-]{1,80}, ?[0-9]{5}$") | low.rlike(r"\b[0-9]{5} [a-z]") | named | leads(low, ("batiment", "immeuble", "residence"))

    return forms(x, judge)


def metadata_line(x: Column) -> Column:
    """Whether a line of a block is contact, registration, payment or opening hours."""

    def judge(text: Column, low: Column) -> Column:
        plain = ("tel", "telephone", "fax", "email", "e-mail", "e_mail", "mail", "contact", "correspondant", "a l'attention", "attention", "info", "infos", "consigne", "code d'ouverture", "horaire", "horaires", "reception", "receptions", "en express", "merci de", "tva", "siret", "siren", "rcs", "iban", "bic", "livraison uniquement", "point de terminaison", "appeler", "prevenir")
        worded = low.rlike(f"^{_either(plain)}(?![a-z0-9_])")
        return worded | low.rlike("^n[o]? ?(intracom|tva)") | low.rlike("^(ve|vir|virement|traite) [0-9]+ ?j( |$)") | low.rlike("^entre [0-9]{1,2} ?h et [0-9]{1,2} ?h") | low.rlike("^[0-9]+ heures? avant")

    return forms(x, judge)


def table_stop(x: Column) -> Column:
    """Whether a row ends a table of lines: a total, a tax, payment, delivery or legal text."""

    def judge(text: Column, low: Column) -> Column:
        totals = ("subtotal", "sub total", "sous-total", "sous total", "net total", "total net", "grand total", "total", "vat", "tva", "tax", "taxe", "mwst", "shipping", "freight")
        begins = low.rlike(f"^{_either(totals)}")
        words = F.concat(F.trim(F.regexp_replace(F.regexp_replace(low, "[.]", ""), "[^a-z0-9]+", " ")), F.lit(" "))
        amount = words.rlike(r"\bmontant ((h ?t)( net)?|net|t ?t ?c) [0-9]") | words.rlike(r"\bmontant (h ?t )?net ") | words.rlike(r"\b(mt|mnt|mi) h ?t [0-9 ]*[0-9]{2} ")
        legal = words.rlike("^retrouvez l ?ensemble de nos (activites|catalogues) ") | low.rlike(r"\bsiege social ?:") | words.rlike("^siren [0-9]") | words.rlike(r"\bau capital de ")
        lead = F.regexp_replace(words, "^[0-9]+ ", "")
        other = lead.rlike("^(a livrer|adresse de livraison|delivery address|mode de reglement|reglement|payment|poids|attention|total hors|montant de port|frais de (port|transport)|(shipping|freight) (charge|cost|fee)) ")
        return begins | amount | legal | other


    return forms(x, judge)