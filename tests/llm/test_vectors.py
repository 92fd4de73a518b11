"""op7_inverted_multi_index against brute force on awkward vectors."""

import numpy as np
from excerpta.llm import multiindex


def test_recall_where_vectors_vary_in_few_directions(spark):
    rng = np.random.default_rng(2)
    parts = []
    for _ in range(2):
        centre = rng.normal(size=64)
        own = np.linalg.qr(rng.normal(size=(64, 4)))[0]
        parts.append(centre / np.linalg.norm(centre) + 0.6 * rng.normal(size=(3000, 4)) @ own.T / 2)
    x = np.concatenate(parts).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r["n_links"] for r in multiindex.op7(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= multiindex.THRESHOLD).sum(axis=1) - 1
    found = np.array([found[i] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.96 * links.sum()


def test_every_length_links_on_its_own(spark):
    rng = np.random.default_rng(4)
    long, short = rng.normal(size=(30, 16)).tolist(), rng.normal(size=(5, 2)).tolist()
    vectors = [*long, *short, *short, *long[:3], [2.0], [-1.0], [3.0], [0.0], None]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in multiindex.op7(df).collect()}
    assert len(got) == len(vectors)
    assert all(got[35 + i][0] > 0 and not got[35 + i][2] for i in range(8))
    assert got[43] == (1, 43, True) and got[44] == (0, 44, True) and got[45] == (1, 43, False)
    assert got[46] == (0, 46, True) and got[47] == (0, 47, True)


def test_lengths_and_double_precision(spark):
    """Vectors of several lengths, of one component, and far outside of a float's range."""
    rows = [(1, [1e300, 2e300, 1e299]), (2, [1e300, 2.01e300, 1e299]), (3, [1e-60, 0.0, 0.0]), (4, [2e-60, 1e-70, 0.0]), (5, [0.0, 1.0]), (6, [0.0, 3.0]), (7, [1.0]), (8, [2.0]), (9, [-1.0]), (10, [1e300, -2e300, 1e299])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multiindex.op7(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7), 9: (0, 9), 10: (0, 10)}


def test_shelves_bound_what_a_task_holds():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 60, 30 * 30)
    counts[77] = 1000
    of, blocks = multiindex.shelves(counts, 30, 100)
    held = np.bincount(of, counts)
    assert (held <= 100 * blocks).all() and (np.diff(of) >= 0).all() and blocks[of[77]] >= 10
    assert all(len(set(np.flatnonzero(of == s) // 30)) == 1 for s in range(len(blocks)))


def test_near_copies_of_the_given_vectors_against_sql(spark):
    """The given vectors hardly link; with near copies of them, half near the threshold, links and components are those of the SQL, but for at most 3 in 100."""
    import duckdb

    base = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], np.float64)[:3000]
    rng = np.random.default_rng(1)
    near = []
    for i, scale in zip(rng.integers(0, len(base), 600), np.linspace(0.05, 0.55, 600)):
        side = rng.normal(size=base.shape[1])
        near.append(base[i] / np.linalg.norm(base[i]) + scale * side / np.linalg.norm(side))
    x = np.concatenate((base, near, base[:20])).astype(np.float32)
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in multiindex.op7(rows).collect()}
    db = duckdb.connect()
    db.register("embeddings", rows.toArrow())
    want = {r[0]: r for r in db.execute(multiindex.ORACLE_SQL).fetchall()}
    links = np.array([want[i][1] for i in range(len(x))])
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert links.sum() > 800 and (found <= links).all() and found.sum() >= 0.97 * links.sum()
    same = [got[i]["component_id"] == want[i][2] for i in range(len(x))]
    assert np.mean(same) >= 0.99 and all(got[i]["component_id"] == want[i][2] for i in np.flatnonzero(links == found) if links[i] == 0)
