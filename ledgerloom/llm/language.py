"""Language ID by rank-order profiles: out-of-place distance between a document's n-grams and each language's.

N-grams are runs of one to three letters in lower case, with one mark for all that stands between words. A language's profile is
its ``TOP`` most frequent n-grams in order, from a bounded sample of labelled documents. A document's ``TOP`` most frequent n-grams are ranked
over its whole text; each costs the difference of its ranks, or ``TOP`` if the profile lacks it. The language with the smallest sum wins.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text none of whose n-grams any profile has is as far from all and
goes to the first language with score 0, as ties go to the first language in code-point order; n-grams that are as frequent are ranked by code
point; a text of any length is counted whole, in pieces that carry the n-grams across their edges; a null doc_id is predicted but never learnt
from; repeated rows are alike; an empty table gives no rows; without labels all are ``und``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textkit import kept_by, slices

#: Ranks of a profile; the most documents a language's profile is made from; characters that are handled at once.
TOP, SAMPLE, CHARACTERS = 300, 2000, 1 << 18
#: Stands in an n-gram for what lies between words; no code point. A code point and the mark take 21 bits.
MARK, BITS = 0x110000, 21
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def codes(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text as numbers that tell them apart, those that end in each piece of the text."""
    text = text.lower() + "\n"
    before, after_letter = np.array([MARK], np.int64), False
    for at in range(0, len(text), CHARACTERS):
        c = np.frombuffer(text[at : at + CHARACTERS].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = letters()[c]
        follows = np.append(after_letter, letter[:-1])
        keep = letter | follows
        after_letter = bool(letter[-1])
        c = np.concatenate((before, np.where(letter, c, MARK)[keep]))
        out = []
        for n in (1, 2, 3):
            first = max(n - 1, len(before))  # the end of the first n-gram that isn't counted yet
            if len(c) <= first:
                continue
            h = np.zeros(len(c) - first, np.int64)
            for j in range(n):
                h = (h << BITS) | c[first - n + 1 + j : len(c) - n + 1 + j]
            if n == 1:
                h = h[c[first:] != MARK]
            elif n == 3:
                h = h[c[first - 1 : len(c) - 1] != MARK]
            out.append(h)
        before = c[-2:]
        yield np.concatenate(out) if out else np.zeros(0, np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, ascending, and how often each occurs."""
    have = n = np.zeros(0, np.int64)
    for piece in codes(text):
        found, m = np.unique(piece, return_counts=True)
        if len(have):
            found, at = np.unique(np.concatenate((have, found)), return_inverse=True)
            m = np.bincount(at, np.concatenate((n, m)), len(found)).astype(np.int64)
        have, n = found, m
    return have, n


def ranked(text: str, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams of a text, the most frequent first."""
    found, n = counts(text)
    if len(n) > 4 * top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        found, n = found[n >= least], n[n >= least]
    return found[np.argsort(-n, kind="stable")[:top]]


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # the n-grams of all profiles, ascending
    ranks: np.ndarray  # languages x n-grams; ``top`` if the profile lacks it
    top: int = TOP

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            own = ranked(text, self.top) if self.languages else np.zeros(0, np.int64)
            if not len(own):
                names.append("und")
                scores.append(0.0)
                continue
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            known = self.grams[at] == own
            rank = self.ranks[:, at[known]]
            cost = np.where(rank < self.top, np.abs(rank - np.flatnonzero(known)), self.top)
            far = cost.sum(1) + self.top * int((~known).sum())
            best = int(np.argmin(far))
            names.append(self.languages[best])
            scores.append(float(1 - far[best] / (len(own) * self.top)))
        return names, scores


def held_out(doc_id: Column) -> Column:
    """Rows that aren't learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _texts(b: pa.RecordBatch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in b.column("text").to_pylist()]


def learn(docs: DataFrame, sample: int = SAMPLE, top: int = TOP) -> Profiles:
    """Profiles from about ``sample`` labelled documents of each language, chosen by hash of doc_id."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), top)
    share = F.element_at(F.create_map(*(x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, sample / n))))), F.col("lang"))
    picked = usable.where((F.pmod(F.xxhash64(F.lit(21), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)) & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("language")
        for b in batches:
            for part in slices(b):
                langs, texts = part.column("lang").to_pylist(), _texts(part)
                for lang in sorted(set(langs)):
                    own = [counts(t) for t, x in zip(texts, langs, strict=True) if x == lang]
                    gram, at = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([n for _, n in own]), len(gram)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    totals = picked.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = totals.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("r") < top)
    rows = best.collect()  # ``top`` rows a language
    languages = sorted({r["lang"] for r in rows}, key=lambda x: x.encode())
    if not languages:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), top)
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(languages), len(grams)), top, np.int64)
    for r in rows:
        ranks[languages.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["r"]
    return Profiles(languages, grams, ranks, top)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("language")
        for b in batches:
            for part in slices(b):
                names, scores = profiles.predict(_texts(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
