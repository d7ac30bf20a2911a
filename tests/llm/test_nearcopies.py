"""Near-copies against brute force over all pairs of texts."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import nearcopies

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return not a and not b or 5 * len(a & b) >= 4 * len(a | b) > 0


def brute_kept(rows):
    """The (doc_id, text) that stay, by the definition."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append((d is None, d or 0, i))
    return sorted((rows[min(g)[2]][0] is None, rows[min(g)[2]][0] or 0) for g in groups.values())


def planted(seed=11):
    """Texts of 60 to 400 words with edits of single words, chains of edits, and a large group around one text."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(5000)}"
    texts = []
    for _ in range(40):
        words = [word() for _ in range(int(rng.integers(60, 400)))]
        texts.append(words)
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            edited = list(words)
            for at in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
                edited[at] = word()
            texts.append(edited)
    hot = [word() for _ in range(200)]
    for i in range(150):
        edited = list(hot)
        edited[i] = word()
        edited[(i * 7) % 200] = word()
        texts.append(edited)
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[at])) for i, at in enumerate(order)]


@pytest.mark.parametrize("name", ["edge_docs", "planted", "sf0.001"])
def test_deduplicate(request, spark, name):
    if name == "planted":
        table = spark.createDataFrame(planted(), "doc_id long, text string")
    elif name == "edge_docs":
        table = request.getfixturevalue(name)
    else:
        table = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.without_near_duplicates(spark, table, DATA)
    assert out.columns == table.columns
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == brute_kept(rows)


def test_no_rows(no_docs):
    assert nearcopies.deduplicate(no_docs).collect() == []


def test_long_texts_have_the_shingles_of_their_words():
    text = " ".join(f"word{i % 9973}" for i in range(90_000)) + " \n" * 300
    assert len(text) > 1 << 19
    assert len(nearcopies.sets([text.encode(), b"a b", b""])[0]) == len(shingles(text))
    assert [len(s) for s in nearcopies.sets([b"a b", b"", b"A b c d e  F"])] == [1, 0, 2]
    assert (nearcopies.keys([b"x y z", b"A b  c d e f"])[1] == nearcopies.keys([b"a b c d e f"])[0]).all()


def test_simhash_links_without_buckets(spark):
    """Copies but for a word of 1,500 lie within two bits: the SimHash join brings them together with no bucket at all."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    words = [f"w{rng.integers(5000)}" for _ in range(1500)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"x{rng.integers(5000)}" for _ in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = nearcopies.with_keys(docs).withColumn("keys", F.array().cast("array<long>")).drop("doc_id")
    named = nearcopies.digests([t.encode() for t in texts]).tolist()
    assert [{r["a"], r["b"]} for r in nearcopies.links(docs, own).collect()] == [set(named[:2])]
