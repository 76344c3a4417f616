"""The pipeline's stages on a small table, each against brute force on its own input."""

import os

import pytest

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    from test_llm import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else None
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "stage")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= set(before)
        if name != "bpe":
            assert docs.columns == columns
        if name == "exact dedup":
            assert after == {min(i for i, u in before.items() if u == t) for t in before.values()}
        if name == "near dedup":
            assert after == {i for i, (_, c) in brute_components(list(before.items()), 5, 80).items() if i == c}
        if name == "bpe":
            assert after == set(before)


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "stage")
        assert docs.count() == 0


def test_awkward_rows_pass_through_all_stages(spark, tmp_path):
    import hashlib
    from collections import Counter

    from test_llm import brute_components, prose

    rows = [(i, prose(i, 80)) for i in range(40)] + [(100 + i, prose(i, 80) + f" end{i}") for i in range(8)] + [(200 + i, prose(30, 80)) for i in range(12)]
    rows += [(300, None), (301, ""), (302, "   "), (3, prose(3, 80)), (None, prose(50, 80)), (None, None), (303, "long " * 30_000), (304, "long " * 29_999 + "other ")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, digest int, node int, row int, key int, topic string, score double"
    docs = spark.createDataFrame([(i, t, [None, "en", "xx"][k % 3], "s", 0, "x", 1, 2, 3, 4, "y", 0.5) for k, (i, t) in enumerate(rows)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, kept = f"file://{tmp_path}", {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "stage")
        assert name == "bpe" or docs.columns == columns
        kept[name] = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()) if name != "bpe" else docs.collect()
    assert kept["quality classifier"] <= Counter(rows)
    texts = lambda c: Counter(t or "" for _, t in c.elements())
    exact = kept["exact dedup"]
    assert texts(exact) == Counter(set(texts(kept["quality classifier"]))) and exact <= kept["quality classifier"]
    assert all(i == min(j for j, u in kept["quality classifier"] if (u or "") == (t or "") and j is not None) for i, t in exact if i is not None)
    # the only row without identifier that is left has a text of its own
    named = [(10_000 if i is None else i, t) for i, t in exact]
    groups = brute_components(named, 5, 80)
    assert {10_000 if i is None else i for i, _ in kept["near dedup"]} == {i for i, (_, c) in groups.items() if i == c}
    assert kept["mixing"] <= kept["near dedup"]
    got = Counter((r.doc_id, r.decoded_sha256) for r in kept["bpe"])
    assert got == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in kept["mixing"].elements())
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r.doc_id for r in kept["bpe"])
    after = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    assert [x.rpartition("-")[0] for x in after - before] == ["bpe"]
