"""Operators, and the whole pipeline, against plain statements of them."""

from collections import Counter

import corpus_pipeline
import numpy as np
import plain
import pytest

from excerpta.llm import bpe, langid, minhash, mixing, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_fingerprints(spark):
    texts = ["", "one", "a b c d", "The Quick brown fox jumps over the lazy dog", " ".join(f"w{i % 50}" for i in range(400)), "x " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in minhash.op2(df).collect()}
    assert [got[i] for i in range(len(texts))] == [plain.fingerprint(t) for t in texts]


def test_languages(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.filter("length(text) < 3000").collect()][:60]
    net = langid.train(langid.training_windows(documents))
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.predicted(documents, net).collect()}
    for i, t in rows:
        lang, score = plain.language(net, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4


def test_bootstrapping(spark):
    rng = np.random.default_rng(3)
    words = "the of and to a in is it on as with his they at be this from".split()
    say = lambda n: " ".join(rng.choice(words, n))
    texts = [f"{say(4)} write to u{i}@site{i % 7}.example.org soon {say(3)}" for i in range(60)]
    texts += [f"{say(3)} write to user{i}@intranet soon" for i in range(8)] + [f"badge of user{i}@intranet seen {say(2)}" for i in range(8)] + ["badge of zoe@lan seen", "colour of zoe@pub unknown 12"]
    texts += [f"{say(2)} call +1 (743) 555-{3000 + i} now" for i in range(9)] + ["please call 555-9999x now", f"card 4111 1111 1111 1111 at 10.0.0.{len(words)} {say(2)}"]
    texts += [f'api key = "k{i}f9c7e5b3d1a0f9" {say(2)}' for i in range(9)] + ['api key = "9z8x7" on', "", None, "no digits here", "a@b " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [[*plain.base_spans(t or ""), *found] for t, found in zip(texts, plain.bootstrapped([t or "" for t in texts]))]
    order = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (pii.FOUND_KINDS.index(s[0]), s[1], s[2])))
    got = {r["doc_id"]: r["spans"] for r in pii.op3(df).collect()}
    assert [got[i] for i in range(len(texts))] == [order(w) for w in want]
    assert sum(len(f) for f in plain.bootstrapped([t or "" for t in texts])) > 20
    assert [r["text"] for r in pii.masked(df).orderBy("doc_id").collect()] == plain.masked(texts)


def test_copies(spark, documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    copies, target, sizes = plain.mixed(spark, rows)
    got = {r["id"]: r for r in mixing.mixed(documents).collect()}
    assert {i: r["copies"] for i, r in got.items()} == copies
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] for r in got.values())


def test_pipeline(spark, documents):
    """Every stage stated again: languages, near copies, personal data, copies, token ids."""
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    net = langid.train(langid.training_windows(documents))
    predicted = {r["id"]: r for r in langid.predicted(documents, net).collect()}  # held against loops above
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    rows = [r for r in rows if predicted[r[0]]["lang_pred"] != langid.NONE and predicted[r[0]]["score"] >= 0.3]
    rows = plain.without_near_copies(rows)
    rows = [(i, t, s) for (i, _, s), t in zip(rows, plain.masked([t for _, t, _ in rows]))]
    copies, _, _ = plain.mixed(spark, rows)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t, _ in rows:
        ids = lib.encode_ordinary(t or "")
        want[i, len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha((t or "").encode())] += copies[i]
    got = Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert got == +want
