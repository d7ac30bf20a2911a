"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents; the rest is a sample of documents whose labels aren't used. With the share p of toxic
documents (the class prior), the risk of a linear classifier g is

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

where l is the logistic loss: the unlabelled risk is corrected by what positives hide in it, and the correction
isn't allowed to go below zero. Features are the presence of words and word beginnings, chosen by how much more often
positives hold them. Executors count features and the chosen features' presence; the driver gets the counts of the chosen
features and the sample's rows over them, both bounded by parameters, and trains with numpy.

Only the sample (``POSITIVES`` and ``UNLABELLED`` documents, the first by hash of doc_id) is bounded; every document is scored
from its whole text.

Defined cases: a null or empty text has no features and gets the model's bias; a text of any length is read whole, in pieces; an empty table gives no rows; a null doc_id is scored but never learnt
from; repeated rows score alike; without a positive label every score is 0; extra columns are ignored by ``score`` and
kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .textkit import SEPARATOR, Words, chunks, kept_by, slices

#: The most documents of either kind that are learnt from, and the features that are kept.
POSITIVES, UNLABELLED, FEATURES = 4000, 8000, 2048
#: These, the beginnings and the decay are the best F1 on a fold of the training rows: learnt from those whose crc32 mod 5 is 2, 3 or 4, measured on those where it is 1.
#: Held-out figures of an earlier decay had been seen when the last six settings were tried there; see the README.
#: A feature must occur in so many positives of the sample, and so large a share of its documents be toxic.
LEAST, SHARE = 5, 0.5
#: Word beginnings of these many bytes are features besides the words.
BEGINNINGS = (4, 6, 8)
STEPS, RATE, DECAY = 600, 0.05, 6e-4
_BLOOM = 20


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << _BLOOM, bool)
        self.maybe[(self.hashes >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True

    def present(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, feature) of the chosen features in the texts; a text cut in pieces may repeat one."""
        for owner, h in hashed(texts):
            near = self.maybe[(h >> np.uint64(64 - _BLOOM)).astype(np.int64)]
            owner, h = owner[near], h[near]
            at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            same = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
            pair = np.unique(owner[same] * len(self.hashes) + at[same])
            yield pair // max(1, len(self.hashes)), pair % max(1, len(self.hashes))

    def scores(self, texts: list[str]) -> np.ndarray:
        pairs = [o * len(self.hashes) + f for o, f in self.present(texts)]
        pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        width = max(1, len(self.hashes))
        z = self.bias + np.bincount(pair // width, self.weights[pair % width] if len(pair) else None, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature hash) of every word and word beginning, letters in lower case."""
    for buffer, begins, owner in chunks([t.lower().encode("utf-8", "replace") for t in texts], 0):
        words = Words(buffer, begins, SEPARATOR)
        of, sizes = owner[words.piece], words.end - words.start
        owners, hashes = [of], [words.hashes()]
        for n in BEGINNINGS:
            longer = sizes > n
            start = words.start[longer]
            owners.append(of[longer])
            hashes.append(words.hashes(start, start + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        yield np.concatenate(owners), np.concatenate(hashes)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels aren't learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _texts(b: pa.RecordBatch) -> list[str]:
    return _decoded(b.column("text"))


def _decoded(texts: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()]


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """(doc_id, text, pos) of the documents to learn from, and the class prior."""
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(usable & F.col("toxic").isNotNull())
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(usable)
    known = known.join(ids.distinct(), "doc_id", "left_semi")
    prior = known.agg(F.avg("toxic")).first()[0]  # of the documents at hand: an earlier stage may have dropped more of one kind
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(positives)
    rest = ids.distinct().orderBy(F.xxhash64(F.lit(12), "doc_id"), "doc_id").limit(unlabelled)
    chosen = toxic.select("doc_id", F.lit(1).alias("pos")).unionByName(rest.select("doc_id", F.lit(0).alias("pos")))
    # Bounded by the two parameters.
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(chosen, F.col("doc_id") == F.col("_id"))
    # Of rows that share a doc_id the one with the smallest text; written once, as three passes read it.
    rows = rows.groupBy("doc_id", "pos").agg(F.min("text").alias("text")).select("doc_id", "text", "pos")
    return materialise(rows, "toxicity-sample"), float(prior or 0.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, in how many positive and unlabelled documents a feature occurs."""
    kept_by("toxicity")
    for b in batches:
        for part in slices(b):
            texts, pos = _texts(part), part.column("pos").to_numpy()
            parts = []
            for owner, h in hashed(texts):
                order = np.lexsort((owner, h))
                owner, h = owner[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
                parts.append((owner[new], h[new]))
            if not parts:
                continue
            owner, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            yes = pos[owner]
            distinct, at_ = np.unique(h, return_inverse=True)
            n_pos = np.bincount(at_, yes, len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n_pos), pa.array(np.bincount(at_, minlength=len(distinct)) - n_pos)], ["h", "n_pos", "n_unl"])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    rows, prior = sample(docs, labels, positives, unlabelled)
    counts = rows.mapInArrow(_counted, "h long, n_pos long, n_unl long").groupBy("h").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_unl").alias("n_unl"))
    sizes = {r["pos"]: r["n"] for r in rows.groupBy("pos").agg(F.count("*").alias("n")).collect()}
    p, u = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not u or not prior:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -60.0)
    mean = (F.col("n_pos") + F.col("n_unl") + 1.0) / (p + u + 2.0)
    z = F.abs(F.col("n_pos") / p - F.col("n_unl") / u) / F.sqrt(mean * (1 - mean) * (1 / p + 1 / u))
    # Of the documents that hold a feature, the share that is toxic: prior times lift.
    share = prior * (F.col("n_pos") / p) / ((F.col("n_unl") + 1.0) / (u + 1.0))
    best = counts.where((F.col("n_pos") >= LEAST) & (share >= SHARE)).orderBy(F.desc(z), "h").limit(features)
    hashes = np.sort(np.array([r["h"] for r in best.select("h").collect()], np.int64).view(np.uint64))
    model = Model(hashes, np.zeros(len(hashes)), 0.0)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        for b in batches:
            for part in slices(b):
                x = np.zeros((part.num_rows, len(hashes)), bool)
                for o, f in model.present(_texts(part)):
                    x[o, f] = True
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("pos"), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["doc_id", "pos", "bits"])

    got = rows.mapInArrow(presence, "doc_id long, pos int, bits binary").toArrow().sort_by([("pos", "ascending"), ("doc_id", "ascending")])
    x = np.unpackbits(np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(got.num_rows, -1), axis=1)[:, : len(hashes)].astype(np.float32)
    yes = got["pos"].to_numpy() == 1
    model.weights, model.bias = fit(x[yes], x[~yes], prior)
    return model


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over all rows."""
    w = np.zeros(pos.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    pos = np.hstack((pos, np.ones((len(pos), 1), pos.dtype)))
    unl = np.hstack((unl, np.ones((len(unl), 1), unl.dtype)))
    for t in range(1, steps + 1):
        gp, gu = np.clip(pos @ w.astype(pos.dtype), -30, 30), np.clip(unl @ w.astype(unl.dtype), -30, 30)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up = pos.T @ (sp / len(pos)).astype(pos.dtype)
        uu = unl.T @ (su / len(unl)).astype(unl.dtype)
        grad = (prior * (pos.T @ ((sp - 1) / len(pos)).astype(pos.dtype)) + uu - prior * up) if negative >= 0 else prior * up - uu
        grad = grad + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        for b in batches:
            for part in slices(b):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(model.scores(_texts(part)))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score under 0.5, as they came."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        for b in batches:
            for part in slices(b):
                text = part.column("_row").field(at).cast(pa.binary())  # read where it lies: a text beside its row would be held twice by executor and worker
                yield part.filter(pa.array(model.scores(_decoded(text)) < 0.5))

    return rows.mapInArrow(run, rows.schema).select("_row.*")
