"""The mix of documents whose columns clash with those of the operator, with repeated rows and hot null ids."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from excerpta.llm import mixing


def test_clashing_columns_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(["w"] * int(n)), f"s{i % 3}", {"a": int(i)}) for i, n in enumerate(rng.integers(0, 60, 400))]
    rows += rows[:30] * 5 + [(None, "no id " * k, "s0", None) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies map<string,int>").withColumns({"size": F.lit(1), "target": F.lit("t"), "block": F.lit(0), "taken": F.lit(2), "__text": F.lit("x")})
    mix = mixing.mix_documents(docs).collect()
    assert mixing.mix_documents(docs).columns == docs.columns
    taken = mixing.mixed(docs).groupBy("id", "size").agg(F.sum("copies").alias("c")).collect()
    want = Counter({(r["id"], r["size"]): r["c"] for r in taken if r["c"]})
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in mix)
    assert got == want


def test_words_come_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    of = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("copies")).alias("most")).collect()
    assert of and all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] and r["most"] <= 2 for r in of)


def test_sources_take_weights_in_turn_however_dealt(spark):
    sizes = spark.createDataFrame([(None, 100), *[(f"s{i:03d}", 100) for i in range(50)]], "source string, source_size long").repartition(7)
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, share=0.5).collect()}
    names = [f"s{i:03d}" for i in range(50)] + [None]
    by_weight = {(5.0, 2.0, 1.0)[i % 3]: got[n] for i, n in enumerate(names)}
    assert all(got[n] == by_weight[(5.0, 2.0, 1.0)[i % 3]] for i, n in enumerate(names))
    assert abs(sum(got.values()) - 0.5 * 5100) < 1e-6
