"""The pipeline against its operators applied one after another by brute force where there is one."""

from collections import Counter

from test_nearcopies import brute_kept

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns
        rows = out.collect()
        seen.append((name, len(rows)))
        before = {r["doc_id"]: r for r in docs.collect()}
        assert all(before[r["doc_id"]] == r for r in rows)
        if name == "near-dedup":
            texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == brute_kept(texts)
        docs = spark.createDataFrame(rows, docs.schema)
    copies = Counter(r["doc_id"] for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    tokens = Counter()
    size = {}
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
        size[r["doc_id"]] = r["doc_tokens"]
    assert tokens == {d: n * size[d] for d, n in copies.items()}
    assert seen[0][1] < 200 and max(copies.values()) <= 3


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_toxicity_sends_a_text_once(spark):
    from ledgerloom.llm import toxicity

    model = toxicity.Model(toxicity.np.zeros(0, toxicity.np.uint64), toxicity.np.zeros(0), -1.0)
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string").selectExpr("doc_id", "text AS TEXT")
    out = toxicity.drop_toxic(docs, model)
    assert out.columns == ["doc_id", "TEXT"] and sorted(map(tuple, out.collect())) == [(1, "a b"), (2, None), (3, "")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(text" not in plan.lower()  # the row alone goes to the workers


def test_a_batch_of_rows_is_read_from_its_own_place(spark, monkeypatch):
    from ledgerloom.llm import toxicity

    word = next(h for _, h in toxicity.hashed(["poison"]))[:1]
    model = toxicity.Model(word, toxicity.np.array([9.0]), -4.0)
    docs = spark.range(1300).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a poison' WHEN id % 3 = 1 THEN 'fine' END AS text").coalesce(1)
    assert [r["doc_id"] for r in toxicity.drop_toxic(docs, model).orderBy("doc_id").collect()] == [i for i in range(1300) if i % 3]
