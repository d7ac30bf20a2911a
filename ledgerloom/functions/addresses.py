"""Postal addresses as column expressions: normal parts, keys, departments, towns and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, let

#: Short forms at the beginning of a street's name.
STREETS = {"AV": "AVENUE", "BD": "BOULEVARD", "RTE": "ROUTE", "CHE": "CHEMIN", "CH": "CHEMIN", "IMP": "IMPASSE", "PL": "PLACE", "ALL": "ALLEE", "ZA": "ZONE ACTIVITE", "ZAC": "ZONE ACTIVITE", "ZI": "ZONE INDUSTRIELLE"}


def part(x: Column) -> Column:
    """Capitals without accents and punctuation; a short form of the street's kind at the beginning is written out."""
    kinds = F.create_map(*(F.lit(v) for pair in STREETS.items() for v in pair))

    def spelled(text: Column) -> Column:
        first = F.substring_index(text, " ", 1)
        long = F.try_element_at(kinds, first)
        return F.when(long.isNotNull(), F.concat(long, F.substring(text, F.length(first) + 1, F.length(text)))).otherwise(text)

    return let(F.upper(fold(x)), spelled)


def number(x: Column) -> Column:
    """As ``part``; a whole number loses its leading zeros."""
    return F.regexp_replace(part(x), "^0+([0-9]+)$", "$1")


def key(house: Column, repetition: Column, street: Column, postal_code: Column, city: Column) -> Column:
    """A hash of the five normal parts; null without number, street, five-digit postal code or city."""
    parts = F.array(number(house), part(repetition), part(street), part(postal_code), part(city))
    there = lambda p, i: F.get(p, F.lit(i)) != ""
    whole = lambda p: there(p, 0) & there(p, 2) & F.get(p, F.lit(3)).rlike("^[0-9]{5}$") & there(p, 4)
    return let(parts, lambda p: F.when(whole(p), F.substring(F.sha2(F.array_join(p, "\u001f"), 256), 1, 32)))


def departments(postal_code: Column) -> Column:
    """The departments that a postal code may lie in: both of Corsica, three digits overseas, else two; none if it isn't five digits."""
    digits = F.regexp_replace(F.coalesce(postal_code, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) != 5, F.array().cast("array<string>")).when(digits.startswith("20"), F.array(F.lit("2A"), F.lit("2B"))).otherwise(F.array(F.when(digits.rlike("^9[78]"), F.substring(digits, 1, 3)).otherwise(F.substring(digits, 1, 2))))


def town(x: Column) -> Column:
    """Struct of city, cedex and cedex_number; the last two are null where CEDEX isn't written."""
    pattern = r"(?i)\bCEDEX(?:\s+(\d{1,2}))?\b"
    tidy = lambda c: F.nullif(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), "^[ ,;-]+|[ ,;-]+$", ""), F.lit(""))
    has = x.rlike(pattern)
    return F.struct(tidy(F.when(has, F.regexp_replace(x, pattern, " ")).otherwise(x)).alias("city"), F.when(has, True).alias("cedex"), F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).alias("cedex_number"))


def label(*parts: Column) -> Column:
    """The parts that aren't empty, joined by commas; of parts equal but for case, accents and punctuation the first."""
    tidy = F.filter(F.array(*(F.trim(F.regexp_replace(F.coalesce(p, F.lit("")), r"\s+", " ")) for p in parts)), lambda p: p != "")
    kept = lambda both: F.filter(both, lambda b, i: F.array_position(F.transform(both, lambda x: x["key"]), b["key"]) == i + 1)
    lines = let(F.transform(tidy, lambda p: F.struct(p.alias("line"), fold(p).alias("key"))), kept)
    return F.nullif(F.array_join(F.transform(lines, lambda b: b["line"]), ", "), F.lit(""))


def fingerprint(label_: Column) -> Column:
    """Twelve hex digits of the label's letters and digits; null if it has none."""
    bare = F.replace(fold(label_), F.lit(" "), F.lit(""))
    return F.when(bare != "", F.substring(F.sha1(bare), 1, 12))
