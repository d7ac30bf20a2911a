"""Quality rules: a table of thresholds compiled into one projection, evaluated by Spark's own functions alone.

``RULES`` names measures of a text and their bounds; ``compile_rules`` turns it into one boolean column. Words are runs of
characters other than U+0020 and U+0009 to U+000D; lines are split at ``\\n``.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are judged alike; a null doc_id
stays null; a text of any length is judged whole, and no rule bounds its words from above; a measure that equals a bound passes; an empty table
gives no rows; extra columns are kept by ``filter_quality`` and ignored by ``judge``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"

#: Frequent function words of the corpus' languages (English, German, French, Spanish).
STOP_WORDS = (
    *("the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for", "on", "as", "was", "are", "by", "this"),
    *("der", "die", "das", "und", "ist", "ein", "eine", "mit", "von", "zu", "den", "nicht", "sich", "auf", "für", "im"),
    *("le", "la", "les", "de", "des", "et", "est", "un", "une", "en", "que", "dans", "pour", "pas", "sur", "par", "du"),
    *("el", "los", "las", "y", "del", "se", "su", "al", "lo", "como", "más", "o", "es", "con", "para"),
)


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose ``measure`` lies in [least, most]; None is no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Bounds on measures from ``measures``.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2, 15),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.02, None),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
    Rule("dup_line_share", None, 0.5),
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null or blank: empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANK}]+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are compared by 64-bit hash. Sorted with their places, equal ones are neighbours; the places of the repeated
    ones, in order, cover three words each, less what the next overlaps.
    """
    n = F.array_size(words)

    def body(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.array_size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return let(F.sort_array(hashed), places)

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)

    return F.when(n < 4, F.lit(0)).otherwise(let(words, body))


def measured(docs: DataFrame) -> DataFrame:
    """Adds a struct ``_m`` of counts and ratios to each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    stop = [*STOP_WORDS]

    def counts(x: Column) -> Column:
        w, ln = x["w"], x["l"]
        n_lines = F.array_size(ln)
        return F.struct(
            F.array_size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            (n_lines - F.array_size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.array_size(F.filter(w, lambda q: F.lower(q).isin(stop))).alias("n_stop"),
            n_lines.alias("n_lines"),
            F.array_size(F.filter(ln, lambda q: F.ltrim(q).rlike("^[-*•]"))).alias("n_bullet"),
            F.array_size(F.filter(ln, lambda q: F.btrim(q, F.lit(BLANKS)).rlike("(\\.\\.\\.|…)$"))).alias("n_ellipsis"),
        )

    return docs.withColumn("_m", let(F.struct(words_of(F.col("text")).alias("w"), lines.alias("l")), counts))


def measures(m: Column) -> dict[str, Column]:
    """The measures that rules can name, from the counts ``m``."""
    per = lambda a, b: F.when(m[b] == 0, F.lit(0.0)).otherwise(m[a] / m[b])
    return {
        "n_words": m["n_words"],
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_share": per("n_stop", "n_words"),
        "bullet_line_share": per("n_bullet", "n_lines"),
        "ellipsis_line_share": per("n_ellipsis", "n_lines"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
    }


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    """One condition that holds if every rule does."""
    have, out = measures(m), F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (have[r.measure] >= r.least)
        if r.most is not None:
            out = out & (have[r.measure] <= r.most)
    return out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, the base verdict and the rules' verdict of each document."""
    m = F.col("_m")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured(picked).select("doc_id", *(m[c].alias(c) for c in counts), base_failed(m).alias("base_failed"), (~base_failed(m) & compile_rules(rules, m)).alias("kept"))


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, as they came."""
    m = F.col("_m")
    return measured(docs).where(~base_failed(m) & compile_rules(rules, m)).select(*(f"`{c}`" for c in docs.columns))
