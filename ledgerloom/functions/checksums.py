"""Check digits of French registrations and VAT numbers, and dates in several orders, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check; false for anything else, null for null."""
    digits = F.split(F.reverse(x), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(2 * d.try_cast("int") - F.when(d.try_cast("int") > 4, 9).otherwise(0)))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return x.rlike("^[0-9]+$") & (total % 10 == 0)


def registration(x: Column) -> Column:
    """Nine or fourteen digits; the whole and its first nine pass the Luhn check."""
    return x.rlike("^([0-9]{9}|[0-9]{14})$") & luhn(x) & luhn(F.substring(x, 1, 9))


def vat_of(siren: Column) -> Column:
    """The French VAT number of a nine-digit registration."""
    key = (12 + 3 * (siren.try_cast("long") % 97)) % 97
    return F.when(siren.rlike("^[0-9]{9}$"), F.concat(F.lit("FR"), F.lpad(key.cast("string"), 2, "0"), siren))


def vat(x: Column) -> Column:
    """Whether a French VAT number has the key of its registration."""
    return F.coalesce(x.rlike("^FR[0-9]{11}$") & (x == vat_of(F.substring(x, 5, 9))), F.lit(False))


def iso_date(x: Column) -> Column:
    """ISO text of a date written year first or day first; null if neither reads it."""
    bare = F.regexp_replace(F.trim(x), "[./]", "-")
    year_first = F.when(bare.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(bare, "yyyy-M-d"))
    day_first = F.when(bare.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.try_to_date(bare, "d-M-yyyy"))
    return F.date_format(F.coalesce(year_first, day_first), "yyyy-MM-dd")


def any_date(x: Column) -> Column:
    """ISO text of a date in one of seven forms: year first with dashes, or day first with slashes, dots or dashes and a year of four or two digits (69 to 99 are 1969 to 1999)."""
    bare = F.trim(F.regexp_replace(x, r"\s+", " "))
    sign = F.regexp_extract(bare, "^[0-9]{1,4}([./-])", 1)
    parts = F.when(F.regexp_replace(bare, "[0-9]", "") == F.concat(sign, sign), F.split(bare, "[./-]"))
    part = lambda i: F.get(parts, F.lit(i))
    long_year = lambda c: c.rlike("^[0-9]{4}$")
    short = F.when(part(2).rlike("^[0-9]{2}$"), F.concat(F.when(part(2).cast("int") >= 69, "19").otherwise("20"), part(2)))
    year, month, day = F.when(long_year(part(0)) & (sign == "-"), part(0)).when(long_year(part(2)), part(2)).otherwise(short), part(1), F.when(long_year(part(0)) & (sign == "-"), part(2)).otherwise(part(0))
    good = month.rlike("^[0-9]{1,2}$") & day.rlike("^[0-9]{1,2}$")
    return F.date_format(F.try_to_date(F.when(good, F.concat_ws("-", year, month, day)), "yyyy-M-d"), "yyyy-MM-dd")


def registration_identifiers(*candidates: Column) -> Column:
    """Struct (siren, siret) of the first of the candidates' digits that pass the checks; a valid SIRET without its own SIREN gives its first nine."""
    digits = F.transform(F.array(*candidates), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""))
    first = lambda n: F.get(F.filter(digits, lambda d: (F.length(d) == n) & registration(d)), F.lit(0))
    siret = first(14)
    return F.struct(F.coalesce(first(9), F.substring(siret, 1, 9)).alias("siren"), siret.alias("siret"))


def vat_equivalent(value: Column, candidate: Column) -> Column:
    """Whether two VAT numbers are the same once the letter O is read as zero, and the number so read is valid."""
    key = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    repaired = lambda c: F.concat(F.substring(key(c), 1, 2), F.translate(F.substring(key(c), 3, 99), "O", "0"))
    return (repaired(value) == repaired(candidate)) & vat(repaired(value))
