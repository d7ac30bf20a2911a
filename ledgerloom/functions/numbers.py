"""Printed numbers as column expressions: amounts in several notations, quantities with their unit, sizes of splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the unit "piece".
PIECES = ("P", "PC", "PCS", "PCE", "PIEC", "PIECE", "PIECES")


def _last(x: Column, sign: str) -> Column:
    """Characters after the last ``sign``; the whole length if there is none."""
    at = F.instr(F.reverse(x), sign)
    return F.when(at == 0, F.length(x)).otherwise(at - 1)


def _decimal_point(x: Column) -> Column:
    """``1.234,5`` and ``1234,5`` with a point; a comma before the last point separates thousands."""
    comma, point = F.contains(x, F.lit(",")), F.contains(x, F.lit("."))
    decimal = F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(comma & ~point, F.replace(x, F.lit(","), F.lit("."))).when(comma & point & (_last(x, ",") < _last(x, ".")), decimal).otherwise(F.replace(x, F.lit(","), F.lit("")))


def money(x: Column) -> Column:
    """An amount whose last separator is the decimal one; currency signs and blanks don't count, null if it isn't a number."""
    bare = F.regexp_replace(x, "[\\s\u00a0]", "")
    return F.regexp_replace(_decimal_point(bare), r"[^0-9+\-.]", "").try_cast("double")


def accounting(x: Column) -> Column:
    """As ``money``; brackets mean negative, apostrophes separate thousands."""
    bare = F.regexp_replace(x, r"[^0-9,.()\-]", "")
    value = _decimal_point(F.regexp_replace(bare, "[()]", "")).try_cast("double")
    return F.when(bare.rlike(r"^\(.*\)$"), -value).otherwise(value)


def native_decimal(x: Column) -> Column:
    """A comma before one to six digits is decimal, so that ``244,49000`` isn't thousands; else as ``accounting``."""
    bare = F.regexp_replace(x, r"[^0-9,.'+\-]", "")
    return F.when(bare.rlike(r"^[+-]?\d*,\d{1,6}$"), F.replace(bare, F.lit(","), F.lit(".")).try_cast("double")).otherwise(accounting(bare))


def _cell(x: Column) -> tuple[Column, Column]:
    """The number in front of a cell without blanks, and what follows it."""
    compact = F.regexp_replace(x, "[\\s\u00a0]+", "")
    number = F.regexp_extract(compact, "^[+-]?[0-9]+", 0)
    decimals = F.regexp_extract(F.substr(compact, F.length(number) + 1, F.lit(7)), "^[.,][0-9]{1,6}", 0)
    head = F.when(number == "", F.lit("")).otherwise(F.concat(number, decimals))
    return head, F.substr(compact, F.length(head) + 1, F.lit(99))


def cell_number(x: Column) -> Column:
    """The number of a table cell with or without a unit; null if the cell holds several numbers."""
    head, rest = _cell(x)
    unit = (rest == "") | rest.isin("€", "$", "£") | (F.length(F.rtrim(rest, F.lit("."))).between(1, 6) & ~F.rtrim(rest, F.lit(".")).rlike("[^A-Za-z]") & (F.length(rest) <= 7))
    joined = F.regexp_replace(F.replace(x, F.lit("\u00a0"), F.lit(" ")), "(?<=[0-9])[ '](?=[0-9]{3}(?![0-9]))", "")
    found = F.regexp_extract_all(joined, F.lit("[0-9]+(?:[.,][0-9]+)*"), 0)
    return F.when((head != "") & unit, F.replace(head, F.lit(","), F.lit(".")).try_cast("double")).when(F.array_size(found) == 1, money(F.get(found, F.lit(0))))


def cell_unit(x: Column) -> Column:
    """The unit right after a quantity, in capitals; all spellings of pieces are ``PCE``."""
    head, rest = _cell(x)
    unit = F.upper(F.rtrim(rest, F.lit(".")))
    good = (head != "") & F.length(unit).between(1, 6) & ~unit.rlike("[^A-Z]") & (F.length(rest) <= F.length(unit) + 1)
    return F.when(good & unit.isin(*PIECES), "PCE").when(good, unit)


def finite(x: Column, default: float = 0.0) -> Column:
    """The number, or ``default`` if it is null, not a number or infinite."""
    number = x.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), default).otherwise(F.coalesce(number, F.lit(default)))


def split_sizes(n: Column, share: float = 0.15) -> Column:
    """Struct of train, validation and test: a share each for the last two, at least one, and one for training before all."""
    held = F.greatest(F.lit(1), F.bround(n * share).cast("long"))
    few = F.when(n <= 0, F.struct(F.lit(0), F.lit(0), F.lit(0))).when(n == 1, F.struct(F.lit(1), F.lit(0), F.lit(0))).when(n == 2, F.struct(F.lit(1), F.lit(1), F.lit(0)))
    kind = "struct<train: long, validation: long, test: long>"
    return F.coalesce(few.cast(kind), F.struct((n - 2 * held).cast("long").alias("train"), held.alias("validation"), held.alias("test")).cast(kind))
