"""The pipeline's stages in order, each on its predecessor's output."""

import corpus_pipeline
from excerpta.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "PII", "mixing sources", "byte-level BPE"]
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 2:
            assert docs.filter("text rlike '[a-z0-9]@[a-z]'").count() == 0
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[4] == counts[5]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_queries_are_named():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
