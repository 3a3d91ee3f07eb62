from collections import Counter

import corpus_pipeline as P
from talkweave.llm.ngram_join import ngram_components

ROOT = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    read = docs
    for k, (name, stage) in enumerate(P.STAGES):
        before = read.collect()
        after = stage(spark, read, ROOT)
        if k < len(P.STAGES) - 1:
            assert after.columns == docs.columns
            assert set(map(tuple, after.collect())) <= set(map(tuple, before))
        if name.startswith("n-gram"):
            comp = {r.doc_id: r.component_id for r in ngram_components(read, 5, 80).collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(set(comp.values()))
        if name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
            assert {r.doc_id for r in before if any(t in r.text for t in items)} <= {r.doc_id for r in before} - {r.doc_id for r in after.collect()}
        if name == "mixing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before}
        read = after
    out = P.run(spark, ROOT).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in before)
    assert [name for name, _ in P.STAGES] == ["language id", "n-gram jaccard join", "benchmark decontamination", "mixing", "sharding"]


def test_odd_rows_pass(spark, documents, tmp_path):
    rows = [(1, "the cat sat on the mat today", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (None, "le chat est sur le tapis", "fr", None), (1, "the cat sat on the mat today", "en", "a"),
            (4, "der hund und die katze sind nicht da", "de", "b"), (5, "x" * 50000, "en", "a")]
    spark.createDataFrame([(1, "w " * 30)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 4, 5, None}
    documents([]).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
