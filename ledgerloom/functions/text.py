"""Normal forms of text as column expressions.

Compatibility forms come from the Unicode database: one table of characters that stand for one other, built once, and one of those
that stand for several, which only texts that hold such a character pay for.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tables() -> tuple[str, str, dict[str, str]]:
    """Of the basic plane: characters whose compatibility form without marks is one Latin character, those characters, and characters whose form holds several, some of them Latin."""
    one, to, many = [], [], {}
    latin = lambda text: any(x.isalnum() and ord(x) < 0x250 for x in text)
    for code in (*range(0xA0, 0xD800), *range(0xF900, 0xFFFE)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c or 0xAC00 <= code < 0xD7A4 or not (latin(plain) or plain.isspace()):
            continue
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        elif len(plain) > 1:
            many[c] = plain
    return "".join(one), "".join(to), many


_ONE, _TO, _MANY = _tables()


def _spans(codes: list[int], gap: int = 256) -> str:
    """A class of few ranges that hold all the code points, and others between them."""
    out: list[list[int]] = []
    for code in sorted(codes):
        if out and code - out[-1][1] <= gap:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


_SEVERAL = _spans([ord(c) for c in _MANY if ord(c) > 0x2FF]) + "|" + _spans([ord(c) for c in _MANY if ord(c) <= 0x2FF], 8)


def unmarked(x: Column) -> Column:
    """Compatibility form of Latin characters without accents and other marks; marks of other scripts go too; a null stays null."""
    known = F.map_from_arrays(F.split(F.lit("\x01".join(_MANY)), "\x01"), F.split(F.lit("\x01".join(_MANY.values())), "\x01"))
    spelled = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.element_at(known, c), c)), "")
    plain = F.regexp_replace(F.translate(F.when(x.rlike(_SEVERAL), spelled).otherwise(x), _ONE, _TO), r"\p{M}+", "")
    return F.when(x.rlike(r"[^\x00-\x7F]"), plain).otherwise(x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_fold(x: Column) -> Column:
    """Compatibility form; what isn't ASCII then goes."""
    return F.regexp_replace(unmarked(F.coalesce(x, F.lit(""))), r"[^\x00-\x7F]+", "")


def squeezed(x: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s  ]+", " "))


def fold(x: Column) -> Column:
    """Lower case ASCII words, one blank for each run of other characters."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(x)), "[^a-z0-9]+", " "))


def fold_spaces(x: Column) -> Column:
    """Lower case ASCII with its punctuation, white space squeezed."""
    return squeezed(F.lower(ascii_fold(x)))


def fold_dates(x: Column) -> Column:
    """Lower case ASCII words that keep the separators of dates."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(x)), "[^a-z0-9/.-]+", " "))


def fold_learned(x: Column) -> Column:
    """Lower case words that keep apostrophes and hyphens."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(x)), "[^a-z0-9'-]+", " "))


def upper_words(x: Column) -> Column:
    """Capitals and digits as words, one blank for each run of others."""
    return F.trim(F.regexp_replace(F.upper(unmarked(F.coalesce(x, F.lit("")))), "[^A-Z0-9]+", " "))


def upper_spaces(x: Column) -> Column:
    """Capitals without marks, white space squeezed."""
    return squeezed(F.upper(unmarked(F.coalesce(x, F.lit("")))))


def upper_key(x: Column) -> Column:
    """Capitals and digits without anything between."""
    return F.regexp_replace(upper_words(x), " ", "")


def identifier(x: Column) -> Column:
    """Capitals without white space; zeros and punctuation stay."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"[\s  ]+", "")


def identifier_small(x: Column) -> Column:
    """Small letters without white space."""
    return F.lower(identifier(x))


def name_key(x: Column) -> Column:
    """Key of a party's name: its ASCII capitals and digits."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]+", "")


def field_value(x: Column) -> Column:
    """Lower case letters and digits of any script, without accents, nothing between."""
    return F.regexp_replace(F.lower(unmarked(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}]+", "")


def anchor_token(x: Column) -> Column:
    """The letters of a word in lower case; empty if there are under three, as short words and values are no anchors."""
    letters = F.regexp_replace(F.lower(unmarked(F.coalesce(x, F.lit("")))), r"[^\p{L}]+", "")
    return F.when(F.length(letters) >= 3, letters).otherwise("")


def tokens(x: Column) -> Column:
    """Words of letters and digits, with inner apostrophes and hyphens, of a learned text."""
    return F.regexp_extract_all(fold_learned(x), F.lit("[a-z0-9]+(?:['-][a-z0-9]+)*"), 0)


def line_spacing(x: Column) -> Column:
    """Single blanks within lines; line breaks stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\S\r\n]+", " "), r" ?(\r?\n) ?", "$1"))


def cell_lines(x: Column) -> Column:
    """The lines of a cell that hold something, squeezed."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\r?\n"), squeezed), lambda v: v != "")


def distinct_folded(lines: Column) -> Column:
    """The lines of an array in their order without those that fold to an earlier or an empty one."""
    keyed = F.filter(F.transform(lines, lambda v: F.struct(fold(v).alias("key"), squeezed(v).alias("line"))), lambda s: s["key"] != "")
    keys = F.transform(keyed, lambda s: s["key"])
    return F.transform(F.filter(keyed, lambda s, i: F.array_position(keys, s["key"]) == i + 1), lambda s: s["line"])


def after_label(x: Column, label: str, stop: str) -> Column:
    """What a row holds between a label and a stop pattern or its end; null if nothing."""
    found = F.regexp_extract(x, f"(?i)(?:{label})\\s*[:#-]?\\s*(.*?)\\s*(?:(?:{stop}).*)?$", 1)
    return F.nullif(F.trim(found), F.lit(""))


def contains_term(x: Column, term: str) -> Column:
    """Whether a folded text holds a term as whole words."""
    return F.contains(F.concat(F.lit(" "), fold(x), F.lit(" ")), F.lit(f" {term} "))


def contexts(x: Column, pattern: str, radius: int, limit: int) -> Column:
    """The first ``limit`` hits of a pattern with up to ``radius`` characters on both sides."""
    return F.slice(F.regexp_extract_all(squeezed(x), F.lit(f"(?i).{{0,{radius}}}(?:{pattern}).{{0,{radius}}}"), 0), 1, limit)


def phrase_count(x: Column, phrase: Column) -> Column:
    """How often a phrase's words stand in a row in a text's words."""
    text, words = F.split(fold(x), " "), F.split(fold(phrase), " ")
    n, m = F.array_size(text), F.array_size(words)
    places = F.when((fold(phrase) != "") & (n >= m), F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_size(F.filter(places, lambda i: F.slice(text, i, m) == words))


def reference_key(x: Column) -> Column:
    """A product reference: capitals and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def nature(key: Column) -> Column:
    """numeric, alpha or mixed."""
    return F.when(key.rlike("^[0-9]+$"), "numeric").when(key.rlike("^[A-Z]+$"), "alpha").when(key == "", None).otherwise("mixed")


def signature(key: Column) -> Column:
    """Run lengths of letters and digits: ``AB123C`` is ``A2-D3-A1``."""
    runs = F.regexp_extract_all(key, F.lit("[A-Z]+|[0-9]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.when(r.rlike("^[0-9]"), "D").otherwise("A"), F.length(r).cast("string"))), "-")


def structural_shape(x: Column) -> Column:
    """Letters as A, digits as 9, white space as a blank, others as they are; of equal ones in a row, one."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"\p{L}", "A"), r"\p{Nd}", "9"), r"\s", " ")
    return F.trim(F.regexp_replace(marked, r"(?s)(.)\1+", "$1"))


def digest(**columns: Column) -> Column:
    """SHA-256 of the columns as JSON, names in order whatever the order given, null fields left out."""
    return F.sha2(F.to_json(F.struct(*(columns[name].alias(name) for name in sorted(columns)))), 256)
