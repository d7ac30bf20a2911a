"""References, codes, phones and order numbers as column expressions: normal forms, shapes, repairs and plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .judgements import any_of, dated_in_words, digits, grouped_phone, prose
from .text import fold, let, squeezed, unmarked

#: Letters that a reader mistakes for digits, and those digits.
CONFUSED, MEANT = "OILZSB", "011258"
#: Words that show that a text is no order number.
FOREIGN = ("code fournisseur", "supplier code", "vendor code", "telephone", "tel ", "fax", "telecopie", "no tva", "siret", "iban", "total", "conditionnement", "poids", "volume", "courriel", "email", "mail", "date de livraison", "livraison souhaitee")
#: The words, besides page numbers, of rows that announce another page, and the most numbers of each.
CONTINUED = {"suite page": 2, "page": 2, "continued page": 1, "continued on page": 1, "fortsetzung seite": 1, "fortsetzung auf seite": 1}
#: Signs that stand around references, not in them.
AROUND = "\"'`()[]{}<>:;,|_ "


def _all(parts: Column, pattern: str) -> Column:
    return F.forall(parts, lambda p: p.rlike(pattern))


def reference(x: Column) -> Column:
    """Capitals without outer punctuation; grouped digits (7 to 13) and split alphanumeric parts are joined, a qualifier as in ``/LM`` goes."""
    bare = F.btrim(unmarked(F.upper(F.coalesce(x, F.lit("")))), F.lit(AROUND))
    halves = F.split(bare, " */ *")
    head, tail = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    grouped = lambda c: _all(F.split(c, "[ .-]+"), "^[0-9]+$")
    base = F.when((F.array_size(halves) == 2) & grouped(head) & tail.rlike("^[A-Z]{1,4}$"), head).otherwise(bare)
    groups, parts = F.split(base, "[ .-]+"), F.split(base, " +")
    joined = F.array_join(groups, "")
    several = (F.array_size(groups) > 1) & grouped(base) & F.length(joined).between(7, 13)
    return F.when(several, joined).when((F.array_size(parts) > 1) & _all(parts, "^[A-Z0-9]+$"), F.array_join(parts, "")).otherwise(base)


def reference_runs(key: Column) -> Column:
    """Run lengths of digits (D), capitals (A) and others (S) of a normal reference: ``D10-A1-D2``."""
    runs = F.regexp_extract_all(key, F.lit("[0-9]+|[A-Z]+|[^0-9A-Z]+"), 0)
    kind = lambda r: F.when(r.rlike("^[0-9]"), "D").when(r.rlike("^[A-Z]"), "A").otherwise("S")
    return F.array_join(F.transform(runs, lambda r: F.concat(kind(r), F.length(r).cast("string"))), "-")


def reference_kind(key: Column) -> Column:
    """digits_only, contains_letter or other."""
    return F.when(key.rlike("^[0-9]+$"), "digits_only").when(key.rlike(r"\p{L}"), "contains_letter").otherwise("other")


def character_shape(x: Column, most: int = 16) -> Column:
    """Runs of capitals, small letters and digits as X, x and d, of another character as one; cut at ``most``."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\p{Lu}", "\u0001"), r"\p{Ll}", "\u0002"), r"\p{Nd}", "\u0003")
    return F.substring(F.translate(F.regexp_replace(marked, r"(?s)(.)\1+", "$1"), "\u0001\u0002\u0003", "Xxd"), 1, most)


def placeholders(x: Column) -> Column:
    """Lower case with dates, amounts and long numbers replaced by their kind."""
    low = F.lower(F.coalesce(x, F.lit("")))
    for pattern, kind in ((r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", " <date> "), (r"\b\d+[.,]\d{2}\b", " <amount> "), (r"\b\d{8,}\b", " <longnum> ")):
        low = F.regexp_replace(low, pattern, kind)
    return low


def party_code(x: Column) -> Column:
    """A code of letters, then digits: letters mistaken for digits in its tail are repaired; anything else stays as it is."""
    raw = F.regexp_replace(F.upper(x), r"\s+", "")
    pattern = f"^([A-Z]{{2,8}})([0-9{CONFUSED}]{{3,12}})$"  # the greedy head is the longest that leaves a tail
    repaired = F.concat(F.regexp_extract(raw, pattern, 1), F.translate(F.regexp_extract(raw, pattern, 2), CONFUSED, MEANT))
    return F.when(raw.rlike("^[A-Z0-9]{5,16}$") & raw.rlike(pattern), repaired).otherwise(x)


def dimensions(x: Column) -> Column:
    """``30 x Z5 MM`` is ``30X25 MM``: a Z read for a 2 inside a numeric dimension."""
    return F.regexp_replace(x, r"(?i)\b([0-9]{1,4}) *[x×] *z *(?=[0-9]{1,4}(?:[^0-9]|$))", "$1X2")


def without_repeats(x: Column) -> Column:
    """Of two equal words in a row the first, of dashes in a row one; null if nothing is left."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace(F.replace(x, F.lit("�"), F.lit("")), r"\s+", " ")), " "), lambda t: t != "")
    keyed = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.upper(F.replace(fold(t), F.lit(" "), F.lit(""))).alias("key")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(state, word):
        pair = (word["key"] != "") & (word["key"] == state["open"])
        dash = (word["token"] == "-") & (F.try_element_at(state["out"], F.lit(-1)) == "-")
        out = F.when(pair | F.coalesce(dash, F.lit(False)), state["out"]).otherwise(F.concat(state["out"], F.array(word["token"])))
        return F.struct(out.alias("out"), F.when(pair, "").otherwise(word["key"]).alias("open"))

    text = F.array_join(F.aggregate(keyed, start, step)["out"], " ")
    return F.nullif(F.regexp_replace(text, "^[ ,;|]+|[ ,;|]+$", ""), F.lit(""))


def _phone(x: Column) -> dict[str, Column]:
    """Parts of a printed phone: its digits, their number, the groups they stand in, and whether a country code leads."""
    v = F.trim(x)
    d = digits(v)
    return {"text": v, "digits": d, "n": F.length(d), "groups": F.regexp_extract_all(v, F.lit("[0-9]+"), 0), "signs": F.length(F.regexp_replace(v, r"[^ .()-]", "")), "plus": F.startswith(v, F.lit("+"))}


def kept_phone(x: Column) -> Column:
    """The text if it is a national number (ten digits from 0) or an international one (10 to 15), else null; not one digit all over."""
    p = _phone(x)
    abroad = p["plus"] | F.startswith(p["digits"], F.lit("00"))
    length = F.when(abroad, p["n"].between(10, 15)).otherwise((p["n"] == 10) & F.startswith(p["digits"], F.lit("0")))
    varied = F.array_size(F.array_distinct(F.split(p["digits"], ""))) > 1
    return F.when(length & varied, p["text"])


def plausible_phone(x: Column) -> Column:
    """7 to 15 digits with a plus, grouping, or ten digits from 0."""
    p = _phone(x)
    size = lambda i: F.length(F.get(p["groups"], F.lit(i)))
    american = (F.array_size(p["groups"]) == 3) & (size(0) == 3) & (size(1) == 3) & (size(2) == 4) & ~p["text"].rlike("[^0-9 .()-]")
    national = F.startswith(p["digits"], F.lit("0"))
    shapes = {"bare": (p["signs"] == 0) & national & (p["n"] == 10), "grouped": (p["signs"] >= 2) & national & p["n"].between(9, 11), "american": american}
    return p["n"].between(7, 15) & (p["plus"] | shapes["bare"] | shapes["grouped"] | shapes["american"])


#: Why a text can't be an order number: a name and a test of its squeezed and its folded form.
ORDER_GUARDS = {
    "empty": lambda text, low: text == "",
    "mail or time": lambda text, low: F.contains(text, F.lit("@")) | F.contains(text, F.lit(":")),
    "label": lambda text, low: any_of(low, FOREIGN),
    "date in words": lambda text, low: dated_in_words(F.trim(low)),
    "prose": lambda text, low: prose(text),
    "phone": lambda text, low: grouped_phone(text),
    "too few digits": lambda text, low: F.length(digits(text)) < 2,
    "signs": lambda text, low: text.rlike("[^A-Za-z0-9 ._/-]") | ~text.rlike("^[A-Za-z0-9]") | ~F.length(text).between(2, 64),
}


def bad_order_number(x: Column) -> Column:
    """Whether a text can't be an order number, by ``ORDER_GUARDS``."""

    def judge(v: Column) -> Column:
        out = F.lit(False)
        for guard in ORDER_GUARDS.values():
            out = out | guard(v["text"], v["low"])
        return out

    return let(F.struct(squeezed(x).alias("text"), F.concat(fold(x), F.lit(" ")).alias("low")), judge)


def continuation_row(x: Column) -> Column:
    """Whether a row only says that the table goes on, or which page this is: known words, then page numbers."""
    most = F.create_map(*(F.lit(v) for kv in CONTINUED.items() for v in kv))

    def judge(parts: Column) -> Column:
        words, numbers = F.filter(parts, lambda p: ~p.rlike("^[0-9]+$")), F.filter(parts, lambda p: p.rlike("^[0-9]+$"))
        return F.coalesce((F.concat(words, numbers) == parts) & F.array_size(numbers).between(F.lit(1), F.element_at(most, F.array_join(words, " "))), F.lit(False))

    return let(F.split(fold(x), " "), judge)
