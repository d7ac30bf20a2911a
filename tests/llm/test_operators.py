"""The ten operators against brute force, on edge cases and on empty tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import fingerprints, language, licenses, mixing, packing, quality, simhash, textkit, toxicity, urlfilter, warc

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ---- packing


def check_packing(rows, texts):
    """``texts``: the rows' (doc_id, text); pieces must tile each, and the sequences must be gapless."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        assert len(parts) <= packing.LIMITS[1]
    ids_of = defaultdict(list)
    for doc_id, text in texts:
        ids_of[doc_id].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    tiles = defaultdict(Counter)
    for r in rows:
        assert any(len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in ids_of[r["doc_id"]])
        tiles[r["doc_id"], r["doc_tokens"]][r["start"]] += 1
        tiles[r["doc_id"], r["doc_tokens"]][r["start"] + r["length"]] -= 1
    whole = Counter()
    for (d, n, _), c in want.items():
        whole[d, n] += c
    # as many pieces begin at each inner place as end there, and all of a document's copies begin at 0 and end at its last id
    assert {k: +t for k, t in tiles.items()} == {k: Counter({0: c}) for k, c in whole.items()}
    assert {k: -t for k, t in tiles.items()} == {k: Counter({k[1]: c}) for k, c in whole.items()}
    return spans


def test_packing_edges(spark, edge_docs):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(edge_docs, PATH, with_ids=True).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for doc_id in (5, 7, 8):
        text = edge_docs.where(F.col("doc_id") == doc_id).first()["text"]
        ids = [i for r in sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"]) for i in r["ids"]]
        assert ids == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]


def test_packing_whole_table(docs):
    rows = packing.pack_documents(docs, PATH).collect()
    spans = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    short = [n for n in (sum(x for _, x in parts) for parts in spans.values()) if n & (n - 1)]
    assert not short


@pytest.mark.parametrize("text", ["", " ", "a  b", " a b ", "x\u00a0 y", "a\n b", "don't <|endoftext|> stop", "tab\t x", "é à\u2009 z", "1 2  3\n\n  4", "a\x1c b"])
def test_tokens_word_by_word(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Ids(PATH)(text), "<u4").tolist() == want


def test_tokens_of_parts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PART", 50)
    text = "The quick brown fox  jumps, over 12 lazy dogs. " * 40
    assert np.frombuffer(packing.Ids(PATH)(text), "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_packing_limits_hold_at_once():
    rng = np.random.default_rng(1)
    packer = packing.Packer((100, 5, 40), cut=False, block=64)
    items = [(i, int(rng.integers(1, 60)), 0) for i in range(500)]
    items = [(i, n, int(rng.integers(0, min(n, 40) + 1))) for i, n, _ in items]
    out = [x for i, n, loss in items for x in packer.add(i, 0, n, loss)] + list(packer.finish())
    assert sorted(x[0] for x in out) == list(range(500))
    loss = {i: x for i, _, x in items}
    for _, part in itertools.groupby(sorted(out, key=lambda x: x[3]), key=lambda x: x[3]):
        part = list(part)
        assert sum(x[2] for x in part) <= 100 and len(part) <= 5 and sum(loss[x[0]] for x in part) <= 40
    assert len({x[3] for x in out}) < 1.25 * max(sum(n for _, n, _ in items) / 100, sum(loss.values()) / 40, 100)


def test_pack_examples(spark):
    rows = spark.createDataFrame([(i, 10 + i % 7, i % 5) for i in range(300)] + [(None, None, None)], "example_id long, tokens long, loss_tokens long")
    out = packing.pack_examples(rows, (64, 4, 9)).collect()
    assert len(out) == 301
    for _, part in itertools.groupby(sorted(out, key=lambda r: r["sequence_id"]), key=lambda r: r["sequence_id"]):
        part = list(part)
        assert sum(r["tokens"] for r in part) <= 64 and len(part) <= 4 and sum(r["loss_tokens"] for r in part) <= 9


def test_pack_turns(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    long_turn = " ".join(f"word{i}" for i in range(3000))
    table = spark.read.parquet(f"{DATA}/conversations.parquet").unionByName(spark.createDataFrame([(None, 0, "assistant", long_turn), (10**6, None, "user", long_turn), (10**6, 1, None, None), (10**6, 1, None, None)], "conv_id long, turn long, role string, text string"))
    rows = packing.pack_turns(table, PATH).collect()
    want, tiles, bears = Counter(), defaultdict(int), {}
    for r in table.collect():
        want[r["conv_id"], r["turn"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        bears[r["conv_id"], r["turn"]] = r["role"] == "assistant"
    for r in rows:
        tiles[r["conv_id"], r["turn"]] += r["length"]
        assert r["loss_tokens"] == r["length"] * bears[r["conv_id"], r["turn"]]
    assert tiles == want
    full = 0
    for _, part in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        part = list(part)
        loss, size = sum(r["loss_tokens"] for r in part), sum(r["length"] for r in part)
        assert loss <= 1024 and size <= 2048 and len(part) <= 64 and [r["offset"] for r in part] == list(itertools.accumulate([0, *(r["length"] for r in part)]))[:-1]
        full += loss == 1024
    assert full  # the limit binds
    assert packing.pack_turns(table.where("false"), PATH).collect() == []


# ---- fingerprints


def test_sketch_matches_plain_sets():
    texts = [b"", b"one two", b"a b c d e", b"a b c d e f g h " * 3, "é ü ß x y z q".encode()]
    whole = fingerprints.sketches(texts, 5, 1.0)
    for t, s in zip(texts, whole, strict=True):
        w = t.split()
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(s.hashes) == len(want)
        back = fingerprints.decode(fingerprints.encode(s))
        assert np.array_equal(back.hashes, s.hashes) and back.least == s.least
    joined = fingerprints.sketches([b"p q r s t u v w x y z"], 5, 0.5)[0]
    assert set(fingerprints.sketches([b"p q r s t u v"], 5, 0.5)[0].hashes) <= set(joined.hashes)
    assert fingerprints.containment(whole[0], whole[0]) == 1 and fingerprints.containment(whole[0], whole[2]) == 0


def test_union_of_sketches_is_the_sketch_of_both_texts():
    rng = np.random.default_rng(8)
    for n, m in ((5, 5), (9, 300), (60, 80)):
        a, b = (" ".join(f"w{x}" for x in rng.integers(0, 99, k)).encode() for k in (n, m))
        both = fingerprints.merge(*fingerprints.sketches([a, b]))
        shingles = {tuple(w[i : i + 5]) for w in (a.split(), b.split()) for i in range(len(w) - 4)}
        one_by_one = [fingerprints.sketches([b" ".join(s)])[0] for s in shingles]
        assert set(both.hashes) == {h for s in one_by_one for h in s.hashes} and both.least == min(s.least for s in one_by_one)


def test_short_texts_without_a_kept_hash():
    texts = [t for i in range(60) if not len(fingerprints.sketches([t := f"a{i} b c d e".encode()])[0].hashes)][:2]
    a, b = fingerprints.sketches(texts)
    assert fingerprints.encode(a).startswith("~") and fingerprints.encode(a) != fingerprints.encode(b)
    assert fingerprints.containment(a, a) == 1 and fingerprints.containment(a, b) == 0 and len(fingerprints.merge(a, b).hashes) == 0
    back = fingerprints.decode(fingerprints.encode(a))
    assert back.least == a.least and not len(back.hashes)


def test_sketch_of_cut_text(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    long_words = b" ".join(bytes([97 + i]) * 1200 for i in range(9))
    texts = [text, text + b" " * 3000, long_words, long_words[:2500]]
    want = fingerprints.sketches(texts, 5, 1.0)
    monkeypatch.setattr(textkit, "CHUNK", 997)
    for s, w in zip(fingerprints.sketches(texts, 5, 1.0), want, strict=True):
        assert np.array_equal(s.hashes, w.hashes) and s.least == w.least
    assert np.array_equal(want[0].hashes, want[1].hashes)


@pytest.mark.parametrize("per_bucket", [1, 3, 1000])
def test_edits_against_brute_force(spark, edge_docs, per_bucket):
    order = sorted(((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["text"] or "", r["doc_id"]) for r in edge_docs.collect()))
    want = []
    for i, (_, text, doc_id) in enumerate(order):
        follows, half = order[(i + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        a, b, c = fingerprints.sketches([x.encode() for x in (text, edited, follows)])
        want.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.encode(a), fingerprints.encode(b), fingerprints.containment(a, b), fingerprints.containment(a, c)))
    got = [(str(r[0]), *r[1:]) for r in fingerprints.compare_with_edits(edge_docs, per_bucket=per_bucket).collect()]
    assert sorted(got) == sorted(want)


def test_fingerprint_documents(edge_docs):
    prints = fingerprints.fingerprint_documents(edge_docs).collect()
    assert len(prints) == 11 and len({r["fingerprint"] for r in prints if r["doc_id"] == 1}) == 1


# ---- quality


def test_quality_edges(edge_docs):
    got = {}
    for r in quality.judge(edge_docs).collect():
        got[r["doc_id"]] = r
    for r in edge_docs.collect():
        text = r["text"] or ""
        w = WORD.findall(text)
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[r["doc_id"]][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[r["doc_id"]]["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w))
    assert quality.filter_quality(edge_docs).columns == edge_docs.columns


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((k for k in sizes if k is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        rest, w = total - sum(out.values()), sum(weight[n] for n in open_)
        over = [n for n in open_ if rest * weight[n] / w > most * sizes[n]]
        if not over:
            out |= {n: rest * weight[n] / w for n in open_}
            break
        out |= {n: most * sizes[n] for n in over}
        open_ -= set(over)
    return out


@pytest.mark.parametrize("name", ["docs", "edge_docs"])
def test_mix(request, name):
    table = request.getfixturevalue(name)
    rows = mixing.mix_counts(table).collect()
    sizes, taken = Counter(), Counter()
    by_doc = Counter((r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in table.collect())
    for (_, n, source), c in by_doc.items():
        sizes[source] += n * c
    want = brute_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter({k: c for k, c in ((x[:2], by_doc[x]) for x in by_doc)})
    source_of = {(d, n): s for d, n, s in by_doc}
    for r in rows:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and len(r["shards"]) <= 3
        taken[s] += r["taken"]
    for s in sizes:
        least = min((n for _, n, x in by_doc if x == s and n), default=0)
        if name == "docs":
                assert abs(want[s] - taken[s]) < 0.03 * want[s] + least
    again = mixing.mix_counts(table.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    out = mixing.mix_documents(table)
    assert out.columns == table.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +Counter({k: sum(len(r["shards"]) for r in rows if r["doc_id"] == k) for k in {r["doc_id"] for r in rows}})


def test_hypergeometric_draws(spark):
    from math import comb

    p = spark.range(4000).select(mixing.hypergeometric(F.lit(40), F.lit(15), F.lit(12), (F.col("id") + 0.5) / 4000).alias("x")).groupBy("x").count().collect()
    for r in p:
        assert r["count"] / 4000 == pytest.approx(comb(15, r["x"]) * comb(25, 12 - r["x"]) / comb(40, 12), abs=0.001)


def test_tree_splits_exactly(spark):
    q = [7, 0, 120, 33]
    rows = mixing.split_quotas(spark.createDataFrame(list(enumerate(q)), "ordinal int, quota long"), 8).collect()
    shares = np.array([np.diff([0, *r["ends"]]) for r in sorted(rows, key=lambda r: r["ordinal"])])
    assert shares.sum(1).tolist() == q and (shares >= 0).all() and np.ptp(shares.sum(0)) <= 1


def test_permuted_order_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(s, b, int(rng.integers(0, 50)), n) for s, n in (("a", 90), (None, 40), ("b", 1)) for b in range(n)]
    table = spark.createDataFrame(rows, "source string, block int, block_words long, n_blocks int")
    whole = {(r["source"], r["block"]): (r["place"], r["before"]) for r in mixing.permuted(table).collect()}
    monkeypatch.setattr(mixing, "RANGE", 8)
    cut = {(r["source"], r["block"]): (r["place"], r["before"]) for r in mixing.permuted(table).collect()}
    assert cut == whole
    words = {(s, b): w for s, b, w, _ in rows}
    for source in ("a", None, "b"):
        order = sorted((p, k) for k, (p, _) in whole.items() if k[0] == source)
        assert [p for p, _ in order] == list(range(len(order)))
        at = 0
        for _, k in order:
            assert whole[k][1] == at
            at += words[k]


def test_tree_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    q = [int(x) for x in np.random.default_rng(6).integers(0, 60, 23)]
    rows = mixing.split_quotas(spark.createDataFrame(list(enumerate(q)), "ordinal int, quota long"), 8).collect()
    shares = np.array([np.diff([0, *r["ends"]]) for r in sorted(rows, key=lambda r: r["ordinal"])])
    assert shares.sum(1).tolist() == q and (shares >= 0).all() and np.ptp(shares.sum(0)) <= 1


# ---- SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    fp = {}
    ids = defaultdict(list)
    for doc_id, f in rows:
        ids[f].append(doc_id)
    prints = list(ids)
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    least = {}
    for f in prints:
        for i in ids[f]:
            if i is not None:
                least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in prints}


@pytest.mark.parametrize("name", ["docs", "edge_docs"])
def test_simhash(request, name):
    table = request.getfixturevalue(name)
    pairs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in table.collect()]
    root = brute_components(pairs)
    want = Counter((d, f"{f:016x}", root[f]) for d, f in pairs)
    assert Counter(tuple(r) for r in simhash.link_documents(table).collect()) == want
    stays = simhash.deduplicate(table)
    assert stays.columns == table.columns
    assert Counter(r["doc_id"] for r in stays.collect()) == Counter({d for d, f in pairs if root[f] in (d, None)})


@pytest.mark.parametrize("dense", [3, 256])
def test_links_keep_all_components(spark, dense):
    rng = np.random.default_rng(3)
    fps = {0}
    for base in rng.integers(0, 1 << 63, 30, dtype=np.uint64).tolist():
        f = int(base)
        for _ in range(25):
            f ^= 1 << int(rng.integers(64))
            if rng.random() < 0.6:
                f ^= 1 << int(rng.integers(64))
            fps.add(f)
    hub = int(rng.integers(0, 1 << 63))
    fps |= {hub ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(8)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), len(fps), dense=dense)
    back = lambda x: x & ((1 << 64) - 1)
    pairs = [(back(r["a"]), back(r["b"])) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    got = simhash.components(edges).collect()
    root = {back(r["node"]): back(r["root"]) for r in got}
    groups = defaultdict(set)
    for f in fps:
        groups[root.get(f, f)].add(f)
    want = defaultdict(set)
    for f, r in brute_components([(f, f) for f in fps]).items():
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_crowded_cells_are_refined(spark):
    """Fingerprints that are crowded in the coarse cells, and some that swap bits within segments, so that fine cells are crowded too."""
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for i, j, k in rng.integers(0, 62, (400, 3))}
    fps |= {sum(1 << (2 * s + (n >> s & 1)) for s in range(31)) for n in range(300)}
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, len(fps), dense=20)).collect()}
    want = brute_components([(f, f) for f in fps])
    groups, same = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[got.get(f, f)].add(f)
        same[want[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))


def test_a_component_without_doc_ids_keeps_one_row(spark):
    text = "some words of a text that is long enough to have a few shingles in it"
    d = spark.createDataFrame([(None, text, "a"), (None, text, "b"), (None, text.upper(), "c"), (4, "other words", "d"), (4, "other words", "e")], "doc_id long, text string, x string")
    first, again = (sorted(map(str, simhash.deduplicate(d.repartition(n)).collect())) for n in (1, 3))
    assert len(first) == 2 and first == again


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    count = lambda x: (x[:, None] >> np.arange(0, 64, 2, dtype=np.uint64) & np.uint64(3))
    want = np.abs(np.bitwise_count(count(a)).astype(int) - np.bitwise_count(count(b)).astype(int)).sum(1)
    got = simhash.manhattan(simhash.embed(a), simhash.embed(b))
    assert (got == want).all() and (got <= np.bitwise_count(a ^ b)).all()


# ---- URL filter


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://COM/en/1", "https://a.b.Example.com/en/7x?q#f", "x://example.com/en/8", "http://notexample.com/en/7", "ftp://de.net/de/8", "http://www.example.net/de/8", "http://a.org", "http://a.org/es/#x", "http://h://k.com/en/", "http://a.com?/en/", "http://É.COM/en/2"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://a.com/en/1", "")], "page_id long, url string, host string")

    def brute(url):
        host = path = ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [(len(h + p), h + p, a) for a, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(pages).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)} | {None: brute("http://a.com/en/1")}
    assert urlfilter.judge(pages, ()).where("verdict <> 'allow'").count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("xxhash64(key) % 3 = 0")
    cascade = urlfilter.build(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.lists(F.col("key")) != (F.expr("xxhash64(key) % 3 = 0")))
    assert wrong.count() == 0
    assert "Join" not in universe.where(cascade.lists(F.col("key")))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [64, 4096, 1 << 26])
def test_lists_over_the_filter_bound_stay_exact(spark, most):
    rules = [("block", f"h{i}.com", "/a") for i in range(200)] + [("allow", "com", "/")]
    urls = [f"http://h{i}.com/{p}" for i in range(400) for p in ("a/1", "b")] * 2 + [None, "http://" + "x" * 5000 + ".com/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, rules, default="none", most=most).collect()}
    listed = {f"http://h{i}.com/a/1" for i in range(200)}
    assert got == {i: "none" if u is None else "block" if u in listed else "allow" for i, u in enumerate(urls)}


# ---- toxicity


def test_toxicity_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(d, toxicity.train(d, lab)).join(lab, "doc_id").where("held_out").groupBy("predicted", "toxic").count().collect()
    n = {(r["predicted"], r["toxic"]): r["count"] for r in got}
    tp, fp, fn = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert 2 * tp / (2 * tp + fp + fn) > 0.88


def test_toxicity_edges(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (10, None)], "doc_id long, toxic int")
    model = toxicity.train(edge_docs, labels)
    out = toxicity.score(edge_docs, model).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    none = toxicity.train(edge_docs, labels.where("false"))
    assert all(r["predicted"] == 0 for r in toxicity.score(edge_docs, none).collect())
    assert toxicity.drop_toxic(edge_docs, none).columns == edge_docs.columns and toxicity.drop_toxic(edge_docs, none).count() == 11


def test_risk_correction_finds_hidden_positives():
    rng = np.random.default_rng(2)
    feature = lambda n, p: (rng.random((n, 20)) < p).astype(np.float32)
    toxic, clean = np.r_[np.full(5, 0.5), np.full(15, 0.1)], np.full(20, 0.1)
    w, b = toxicity.fit(feature(500, toxic), np.vstack((feature(300, toxic), feature(700, clean))), 0.3)
    assert ((feature(1000, toxic) @ w + b) > 0).mean() > 0.7 and ((feature(1000, clean) @ w + b) > 0).mean() < 0.15


def test_risk_and_gradient_by_hand():
    """One step of the trainer against the non-negative risk in plain Python."""
    from math import exp, log

    pos, unl, prior = [[1, 0], [1, 1]], [[0, 1], [1, 0], [0, 0]], 0.4
    loss = lambda z: log(1 + exp(-z))

    def risk(w):
        g = lambda x: w[0] * x[0] + w[1] * x[1] + w[2]
        negative = sum(loss(-g(x)) for x in unl) / 3 - prior * sum(loss(-g(x)) for x in pos) / 2
        return (prior * sum(loss(g(x)) for x in pos) / 2 + negative) if negative >= 0 else -negative

    start = [0.0, 0.0, log(prior / (1 - prior))]
    slope = [(risk([w + (1e-6 if i == j else 0) for j, w in enumerate(start)]) - risk([w - (1e-6 if i == j else 0) for j, w in enumerate(start)])) / 2e-6 for i in range(3)]
    w, b = toxicity.fit(np.array(pos, np.float64), np.array(unl, np.float64), prior, steps=1, rate=0.1, decay=0.0)
    # the first step of Adam goes its whole rate against the sign of the gradient
    assert np.allclose([*w, b], [x - 0.1 * np.sign(s) for x, s in zip(start, slope, strict=True)], atol=1e-4)


def test_repeated_rows_are_learnt_from_once(spark):
    rows = [(1, "bad words here")] * 50 + [(i, f"good text {i}") for i in range(2, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sample, _ = toxicity.sample(d, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), 10, 100)
    assert sample.where("pos = 1").count() <= 1 and sample.groupBy("doc_id", "pos").count().where("count > 1").count() == 0


# ---- WARC


def test_warc(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/1", big), (3, "http://a/2\r\nEvil: 1", big), (9, None, big), (9, None, big), (3, "u", big), (7, "http://a/4", None), (8, "", ""), (None, "http://n", big), (11, "http://é", "é" * 60), (12, "z", "short"), (13, "z", "short")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None and len(data) >= 100]
        refers = min(same) if same and page is not None and page > min(same) else None
        want[page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert got == want


def test_warc_payloads_and_selection(spark, monkeypatch):
    from ledgerloom.llm.store import new_path

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    folder = new_path(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    some = index.where("page_id % 3 = 0")
    got = {r["page_id"]: (r["url"], bytes(r["payload"]).decode()) for r in warc.read_records(some, folder).collect()}
    assert got == {r["page_id"]: (r["url"], r["html"]) for r in pages.where("page_id % 3 = 0").collect()}


def test_ranges_cover_and_coalesce():
    assert list(warc.ranges([(0, 10), (10, 5), (100, 5), (500, 5)], gap=90, most=1000)) == [(0, 105, 0, 3), (500, 5, 3, 4)]
    assert list(warc.ranges([(0, 10), (10, 10)], gap=5, most=12)) == [(0, 10, 0, 1), (10, 10, 1, 2)]


# ---- licences


def test_licenses(spark):
    texts = [None, "", "word", "prose here\nLicensed under the Apache License, Version 2.0.\nmore prose", licenses.TEMPLATES[4][1], "RELEASED UNDER THE MIT-LICENSE", "Released under the old MIT License.", "this is no licence at all but it is long enough to have bigrams", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x y z", 0)], "doc_id long, text string, license int")

    def grams(t):
        w = re.sub(r"[\W_]+", " ", t.lower()).split()
        return set(zip(w, w[1:], strict=False))

    def brute(text):
        text = text or ""
        units = text.split("\n") + ([text] if "\n" in text else [])
        hits = []
        for u in units:
            g = grams(u)
            best = max(((2 * len(g & b) / (len(g) + len(b)), -i) for i, b in enumerate(grams(x) for _, x in licenses.TEMPLATES) if g), default=(0, 0))
            if best[0] >= 0.8:
                hits.append(best)
        top = max(hits, default=None)
        return (licenses.TEMPLATES[-top[1]][0] if top else None, top[0] if top else 0.0, len(hits))

    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    want = {i: brute(t) for i, t in enumerate(texts)} | {None: brute("x y z")}
    assert {k: (v[0], pytest.approx(v[1]), v[2]) for k, v in want.items()} == got
    assert got[3][0] == "Apache-2.0" and got[4][0] == "MIT" and got[7][0] is None


# ---- language


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(d, language.learn(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97


def test_language_edges(edge_docs, monkeypatch):
    profiles = language.learn(edge_docs)
    rows = language.identify(edge_docs, profiles).collect()
    assert len(rows) == 11
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4)) and 0 <= r["score"] <= 1 for r in rows)
    text = edge_docs.where("doc_id = 5").first()["text"]
    texts = [text, "und der", "x" * 5000, "漢字 と 仮名"]
    whole = profiles.predict(texts)
    monkeypatch.setattr(language, "CHARACTERS", 101)
    assert profiles.predict(texts) == whole


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    marked = " " + " ".join(words) + " "
    found = Counter(marked[i : i + n] for n in (1, 2, 3) for i in range(len(marked) - n + 1)) if words else Counter()
    return Counter({g: n for g, n in found.items() if g != " " and not (len(g) == 3 and g[1] == " ")})


def test_language_is_out_of_place_distance(spark):
    """Against the definition in plain Python, with ties by code point, the mark after all letters."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    order = lambda g: [0] * (3 - len(g)) + [0x110000 if c == " " else ord(c) for c in g]
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], order(x[0])))[:300]]
    profiles = language.learn(d, sample=10**6)
    totals = defaultdict(Counter)
    for r in d.where(F.col("lang").isNotNull()).collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            totals[r["lang"]] += plain_grams(r["text"] or "")
    ranks = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in totals.items()}
    for r in d.limit(60).collect() + [{"text": "xyz"}, {"text": "漢字"}]:
        own = top(plain_grams(r["text"] or ""))
        name, score = profiles.predict([r["text"] or ""])
        if not own:
            assert (name, score) == (["und"], [0.0])
            continue
        far = {lang: sum(abs(i - known[g]) if g in known else 300 for i, g in enumerate(own)) for lang, known in ranks.items()}
        best = min(sorted(far), key=far.get)
        assert name == [best] and score[0] == pytest.approx(1 - far[best] / (300 * len(own)))


# ---- all


def test_empty_tables(spark, no_docs):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        packing.pack_documents(no_docs, PATH), fingerprints.compare_with_edits(no_docs), fingerprints.fingerprint_documents(no_docs), quality.judge(no_docs), quality.filter_quality(no_docs), mixing.mix_counts(no_docs), mixing.mix_documents(no_docs),
        simhash.link_documents(no_docs), simhash.deduplicate(no_docs), urlfilter.judge(pages), toxicity.score(no_docs, toxicity.train(no_docs, labels)), warc.round_trip(pages), licenses.scan(no_docs), language.identify(no_docs, language.learn(no_docs)),
    ):
        assert out.collect() == []
