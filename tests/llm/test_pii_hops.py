"""op3_bootstrapped_pii finds identifiers of any shape, and through values that it found itself."""

from excerpta.llm import pii

UNSEEN = ("jane@intranet", "@janedoe", "jane.doe[at]site.org", "jane.doe(AT)site.org", "ab1", "x@y")


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii.op3(df).filter("n_found > 0").collect()}


def test_identifiers_without_three_digits(spark):
    seeds = [f"please send it to user{i}@site{i}.example.org today ok" for i in range(60)]
    unseen = [f"please send it to {v} today ok" for v in UNSEEN]
    got = found(spark, [*seeds, *unseen, "the word else@where is elsewhere"])
    assert got == {60 + i: f"email:18:{18 + len(v)}" for i, v in enumerate(UNSEEN)}


def test_found_values_induce_patterns(spark):
    seeds = [f"please send it to user{i}@site{i}.example.org today ok" for i in range(90)]
    first = [f"please send it to name{i}@intranet today ok" for i in range(12)]
    again = [f"the badge of name{i}@intranet was seen" for i in range(12)]
    got = found(spark, [*seeds, *first, *again, "the badge of zoe@lan was seen", "the colour of zoe@pub is unknown"])
    assert set(got) == {*range(90, 90 + 25)} and got[114] == "email:13:20"


def test_secrets_by_context(spark):
    """Long keys teach the words before them; shorter ones in the same place are found, and long ones elsewhere are left."""
    long = [f'the login token = "a{i:02d}f9c7e5b3d1a0{i:02d}" works' for i in range(30)]
    got = found(spark, [*long, 'the login token = "9z8x" works', "this is commit a1b2c3d4e5f6a7b8c9d0 of today", "no numbers at all"])
    assert set(got) == set(range(31)) and got[30] == "secret:19:23" and all(v.startswith("secret:19:") for v in got.values())


def test_found_in_the_test_documents(spark):
    """Of the documents with a token, all are found; nothing is found in documents without one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.select("doc_id", docs.text.rlike('token = "[0-9a-f]+"').alias("token")).collect()
    hit = {r["doc_id"] for r in pii.op3(docs).filter("n_found > 0").collect()}
    planted = {r["doc_id"] for r in rows if r["token"]}
    assert len(planted) > 50 and len(hit & planted) >= 0.95 * len(planted) and len(hit - planted) <= 0.02 * len(hit)
