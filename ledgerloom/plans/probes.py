"""Queries of functions of one printed text: every part's row prints one of several texts, and the SQL holds the values that each must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import query, table


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "concat(" + ", ".join("CAST(p_partkey AS VARCHAR)" if part == "{k}" else "'" + part.replace("'", "''") + "'" for part in _parts(value)) + ")"
    if isinstance(value, list):
        return "[" + ", ".join(_sql(v) for v in value) + "]"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)


def _parts(text: str) -> list[str]:
    out: list[str] = []
    for i, piece in enumerate(text.split("{k}")):
        out += (["{k}"] if i else []) + ([piece] if piece else [])
    return out or [""]


def _printed(text: str | None) -> Column:
    if text is None:
        return F.lit(None).cast("string")
    return F.concat(*(F.col("p_partkey").cast("string") if part == "{k}" else F.lit(part) for part in _parts(text)))


def probe(name: str, functions: dict[str, Callable[[Column], Column]], rows: list[tuple], kinds: dict[str, str] | None = None) -> None:
    """``rows``: a text (``{k}`` is the part's key), then the value of each function for it. ``kinds``: SQL types of columns that hold nulls alone or lists."""
    kinds = kinds or {}
    n = len(rows)
    case = lambda values: "CASE p_partkey % " + str(n) + " " + " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(values)) + " END"
    typed = lambda f, values: f"CAST({case(values)} AS {kinds[f]})" if f in kinds else case(values)
    columns = ", ".join(f"{typed(f, [r[i + 1] for r in rows])} AS {f}" for i, f in enumerate(functions))

    def run(spark, sf):
        part = table(spark, sf, "part")
        text = F.when(F.lit(False), F.lit(None).cast("string"))
        for i, r in enumerate(rows):
            text = text.when(F.col("p_partkey") % n == i, _printed(r[0]))
        printed = part.select("p_partkey", text.alias("printed"))
        return printed.select("p_partkey", "printed", *(f(F.col("printed")).alias(c) for c, f in functions.items()))

    run.__name__ = name
    query(f"SELECT p_partkey, {case([r[0] for r in rows])} AS printed, {columns} FROM part")(run)
