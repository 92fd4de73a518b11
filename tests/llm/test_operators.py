"""The training-data operators against plain re-statements, on small tables with every awkward row."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from excerpta.llm import bpe, components, langid, minhash, mixing, multiindex, pii, resampling, simhash, suffixes, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [w for w in "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    a, b = prose(1, 300), prose(2, 200)
    near = a.replace(a.split()[150] + " ", "changed ", 1)
    shared = prose(3, 60)
    texts = [a, a, near, b, None, "", " \t\n", "one", "two words", prose(4, 40) + " " + shared, shared + " " + prose(5, 50), "x" * 30_000, "mail me@site.example.org or +1 (743) 555-3824, card 4111 1111 1111 1111 at 10.0.0.255", "Größe naïve 日本語 " * 5, "ab" * 200, "ab" * 60]
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s1", "s2", None)[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id here at all", "en", "s1", 17), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("key", F.lit(2)).withColumn("block", F.lit(3)).withColumn("size", F.lit(4))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 --------------------------------------------------------------------------------------------------


def test_canonical_urls(spark):
    pairs = [("HTTP://WWW.Site.Example:80/a/?b=2&a=1&utm_source=x#f", "site.example/a?a=1&b=2"), ("https://u@site.example/", "site.example"), ("site.example/x?ref=1", "site.example/x"), (None, None)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(pairs)], "i int, u string").select("i", warc.canonical_url(F.col("u")).alias("c"))
    assert [r["c"] for r in df.orderBy("i").collect()] == [c for _, c in pairs]


def test_revisits_against_a_loop(spark):
    rng = np.random.default_rng(4)
    recs = []
    for i in range(400):
        url = None if i % 50 == 0 else f"http://h/{int(rng.integers(0, 3)) if i % 3 else 0}"
        kind = "response" if rng.random() < 0.3 else "revisit"
        recs.append((i, url, int(rng.integers(0, 100)), kind, bool(rng.random() < 0.8), f'"{int(rng.integers(0, 3))}"' if rng.random() < 0.6 else None, f"d{int(rng.integers(0, 2))}" if rng.random() < 0.6 else None, {"date": str(i), "content-length": "1", f"x{i % 3}": "v"}))
    df = spark.createDataFrame(recs, "record_id long, url string, ts long, kind string, full boolean, etag string, last_modified string, headers map<string,string>").withColumn("payload", F.lit("p")).withColumn("block", F.lit("clash"))
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert set(got) == {r[0] for r in recs if r[3] == "revisit"}
    for i, url, ts, _, _, etag, date, headers in (r for r in recs if r[3] == "revisit"):
        past = [r for r in recs if url and r[1] == url and r[3] == "response" and r[4] and r[2] < ts]
        best = max(past, key=lambda r: (r[2], r[0]), default=None)
        assert got[i]["response_id"] == (best and best[0])
        same = None if best is None else etag == best[5] if etag and best[5] else date == best[6] if date and best[6] else None
        want = "no_response" if best is None else {None: "unchecked", True: "resolved", False: "mismatch"}[same]
        assert got[i]["outcome"] == want
        if want in ("resolved", "unchecked"):
            assert got[i]["headers"] == {**best[7], **{k: v for k, v in headers.items() if k != "content-length"}}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


# ---- 2 --------------------------------------------------------------------------------------------------


def test_minhash_contract(docs, rows):
    got = minhash.op2(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = []
    for k, r in enumerate(order):
        t, n = r[1] or "", order[(k + 1) % len(order)][1] or ""
        c = len(t) // 3
        expected.append((r[0], len(t), hashlib.sha256((t[: len(t) - c] + n[:c]).encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(expected, key=key)
    by_text = {}
    for r in got:
        text = next(x[1] or "" for x in rows if x[0] == r["doc_id"] and len(x[1] or "") == r["n_chars"])
        by_text.setdefault(text, set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())


def test_minhash_estimates(spark):
    pairs = [(prose(i, 300), " ".join([*prose(i, 300).split()[: int(300 * s)], *prose(i + 500, 300).split()[int(300 * s) :]])) for i in range(20) for s in (0.1, 0.5, 0.9)]
    df = spark.createDataFrame(pairs, "a string, b string").select(minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("l"))
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    true = [len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for a, b in pairs]
    errors = [r["l"] - t for r, t in zip(df.collect(), true)]
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


def test_minhash_empty_table(empty):
    assert minhash.op2(empty).count() == 0


def test_next_over_many_blocks(spark):
    ids = sorted({int(x) for x in np.random.default_rng(1).integers(-(10**15), 10**15, 500)} | set(range(100)), reverse=True)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "key long, text string")
    got = {r["key"]: r["next_text"] for r in minhash.with_next(df, "key", "text", ["text"]).collect()}
    assert got == {i: str(ids[(k + 1) % len(ids)]) for k, i in enumerate(ids)}


# ---- 3 --------------------------------------------------------------------------------------------------

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in BASE:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base(spark, docs, rows):
    nasty = [(100, "a@b.c%d@e.f.g x@y 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 +12 (34) 567-8901 é4111111111111111"), (101, "é" * 50 + " ab.c@x.y.z " * 300), (102, "9" * 5000 + " 1.2.3.4 " * 200), (103, "a." * 3000 + "a@" + "b." * 3000 + "c"), (104, "\U0001f600 10.1.1.1"), (105, "a" * 60000)]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(nasty, "doc_id long, text string"), allowMissingColumns=True)
    got = pii.op3(df).collect()
    want = sorted((str(i), hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in [*[(r[0], r[1]) for r in rows], *nasty])
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want


def test_pii_finds_what_seeds_teach(spark):
    seeds = [(i, f"please call office line +1 (555) 010-{1000 + i} today ok") for i in range(40)]
    unseen = [(100, "please call office line 555-010-7777x today ok"), (101, "the room 555-010-7777y is free"), (102, "no numbers")]
    got = {r["doc_id"]: r for r in pii.op3(spark.createDataFrame(seeds + unseen, "doc_id long, text string")).collect()}
    assert got[100]["n_found"] == 1 and got[100]["spans"].startswith("phone:24:") and got[101]["n_found"] == 0 and got[102]["n_found"] == 0
    assert all(got[i]["n_phone"] == 1 and got[i]["n_found"] == 0 for i in range(40))


def test_pii_masks(docs, rows, empty):
    out = pii.masked(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    text = next(r for r in got if r["doc_id"] == 12)
    assert text["text"] == "mail <email> or <phone>, card <card> at <ip>" and text["n_chars"] == len(text["text"])
    assert sorted(str(r["text"]) for r in got if r["doc_id"] != 12) == sorted(str(r[1]) for r in rows if r[0] != 12)
    assert pii.masked(empty).count() == 0 and pii.op3(empty).count() == 0


# ---- 4 --------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows, empty):
    many = [(i, " ".join(["w"] * (i * 37 % 300)), "en", f"s{0 if i % 3 == 0 else i % 7}", 0) for i in range(900)]
    df = spark.createDataFrame(many, SCHEMA)
    got = mixing.op4(df).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.op4(df.repartition(7)).collect()}
    sizes, taken, target, source = {}, {}, {}, {r[0]: r[3] for r in many}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == again[r["doc_id"]]
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            want |= share
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(want[s] for s in full)
        free -= full
    for s in names:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - target[s]) <= 0.02 * target[s] + 1
    assert mixing.op4(docs).count() == len(rows) and mixing.op4(empty).count() == 0
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mix.collect()) == sum(r["taken"] for r in mixing.op4(docs).collect())


# ---- 5 --------------------------------------------------------------------------------------------------


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = [*rng.integers(1, rng.choice([2, 3, 30]) + 1, rng.integers(0, 60)).tolist(), 0]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows):
    pairs = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for k, _, b in pairs:
        for j in range(len(b) - 49):
            w = b[j : j + 50]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, i, b in pairs:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < k:
                gone[j : j + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(docs, rows, empty):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.op5(docs).collect()), key=str)
    assert got == brute_repeats([(r[0], r[1]) for r in rows]) and suffixes.op5(empty).count() == 0


def earliest_by_window(token, ctx, doc):
    out = np.empty((len(ctx), suffixes.SIDE + 1), np.int64)
    for j in range(suffixes.SIDE + 1):
        first = {}
        for t, c, d in zip(token, ctx, doc):
            k = (t, *c[j : suffixes.SIDE + j])
            first[k] = min(first.get(k, d), d)
        out[:, j] = [first[(t, *c[j : suffixes.SIDE + j])] for t, c in zip(token, ctx)]
    return out


@pytest.mark.parametrize("symbols", [100, 700, 3000, 200_000])
def test_hot_contexts_agree(monkeypatch, symbols):
    monkeypatch.setattr(suffixes, "ARRAY_SYMBOLS", symbols)
    rng = np.random.default_rng(3)
    ctx, doc = (rng.random((300, 2 * suffixes.SIDE)) < 0.1).astype(np.int16), rng.integers(0, 99, 300)
    ctx = np.concatenate((ctx, ctx[:40]))
    ctx[300:, -1] ^= 1
    doc, token = np.concatenate((doc, rng.integers(0, 99, 40))), np.sort(rng.choice(4, 340, p=[0.7, 0.1, 0.1, 0.1]))
    assert (suffixes._earliest(token, ctx, doc) == earliest_by_window(token, ctx, doc)).all()


@pytest.mark.parametrize("hot", [0, 2, 10**9])
def test_repeats_with_hot_anchors(spark, hot):
    """A line and a short phrase that most documents share, in packs of a few texts, against all strings."""
    rng = np.random.default_rng(11)
    line, phrase = prose(20, 14), prose(21, 8)[:41]
    rows = []
    for i in rng.permutation(90).tolist():
        words = prose(100 + i, int(rng.integers(3, 40))).split()
        at = int(rng.integers(0, len(words)))
        rows.append((i, " ".join([*words[:at], line if i % 3 else phrase, *words[at:], phrase if i % 2 else ""])))
    rows += [(100, rows[0][1]), (101, line * 3), (102, line * 2), (102, line * 2), (103, phrase)]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot_texts=hot).withColumnRenamed("id", "doc_id").collect()), key=str)
    assert got == brute_repeats(rows)


def test_anchors_of_long_texts(monkeypatch):
    b = np.frombuffer(("x" * 200 + prose(9, 3000) + "ab" * 300).encode(), np.uint8)
    whole = suffixes._anchors(b)
    for n in (64, 1000, 4097):
        monkeypatch.setattr(suffixes, "STRETCH", n)
        assert all((x == y).all() for x, y in zip(suffixes.anchors(b), whole))


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    first = suffixes.F.xxhash64
    monkeypatch.setattr(suffixes.F, "xxhash64", lambda *a: first(*a) if len(a) > 1 else F.lit(1).cast("long"))
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "text string")
    got = {r[0]: r[1] for r in suffixes.named_texts(rows).collect()}
    assert len(set(got.values())) == 3


# ---- 6 --------------------------------------------------------------------------------------------------


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(items, linked):
    least = {i: i for i in range(len(items))}
    root = lambda i: i if least[i] == i else root(least[i])
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                least[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def test_simhash(docs, rows, empty):
    prints = [brute_simhash(r[1]) for r in rows]
    group = reachable(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {g: min((r[0] for r, x in zip(rows, group) if x == g and r[0] is not None), default=None) for g in set(group)}
    want = sorted((str(r[0]), f"{p:016x}", str(least[g])) for r, p, g in zip(rows, prints, group))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.op6(docs).collect()) == want
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({r[0] for r, g in zip(rows, group) if r[0] is not None and r[0] == least[g]})
    assert simhash.op6(empty).count() == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    other = base.copy()
    for i in range(2000):
        for b in rng.choice(64, i % 5, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    sets = [{}, {}]
    for s, fps in zip(sets, (base, other)):
        for k, r in zip(*simhash.golay_keys(fps)):
            s.setdefault(int(r), set()).add(int(k))
    assert all(sets[0][i] & sets[1][i] for i in range(2000))


def test_spanning_links_keep_components():
    fps = np.array([0, 0b1111, 0b11111111, 31 << 40, (31 << 40) | 7, 63 << 55], np.uint64)
    a, b = simhash.spanning_links(fps, 4)
    got = reachable(range(6), lambda i, j: any({int(x), int(y)} == {int(fps[i]), int(fps[j])} for x, y in zip(a, b)))
    assert len(set(got)) == 3 and len(a) == 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3), (2000, 1000)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long").repartition(8)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, 2000: 1000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 7 --------------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(600, 16))
    x = np.concatenate((base, base[:200] + 0.05 * rng.normal(size=(200, 16)), np.repeat(base[:1], 50, 0) + 0.02 * rng.normal(size=(50, 16)), base[:3])).astype(np.float32)
    odd = [(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] * 16), (-4, [None] * 16), (-5, []), (-6, [float("inf")] * 16)]
    df = spark.createDataFrame([*enumerate(x.tolist()), *odd], "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).withColumn("links", F.lit(1))
    got = {r["vec_id"]: r for r in multiindex.op7(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd)
    assert got[len(x) - 1]["component_id"] == 2
    assert multiindex.op7(df.limit(0)).count() == 0


# ---- 8 --------------------------------------------------------------------------------------------------


def speech(seed, letters, n=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))


def test_language(spark, docs, rows, empty):
    kinds = {"xx": "abcdeé", "yy": "mnopqü", "zz": "rstuvw"}
    table = [(i, speech(i, kinds[k]), k, "s", 0) for i, k in enumerate(list(kinds) * 60)] + [(900, None, "xx", "s", 0), (901, "123 !!", "xx", "s", 0), (902, "mn", None, "s", 0)]
    got = {r["doc_id"]: r for r in langid.op8(spark.createDataFrame(table, SCHEMA)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in table)
    held = [i for i, t, *_ in table if t and i < 900 and got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == table[i][2] for i in held]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.op8(docs).count() == len(rows) and langid.op8(empty).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({4, 5, 6})


def test_tables_equal_the_network():
    net = langid.ByteConvNet(["a", "b"])
    x = np.stack([langid.windows_of(prose(i, 30).encode())[0] for i in range(5)])
    e = net.p["e"][x]
    h = [np.concatenate([e[:, i : langid.WINDOW_BYTES - k + 1 + i] for i in range(k)], axis=2) @ net.p[f"f{k}"] for k in langid.WIDTHS]
    pooled = np.concatenate([a.max(axis=1) + net.p[f"c{k}"] for a, k in zip(h, langid.WIDTHS)], axis=1)
    want = langid.softmax(np.maximum(pooled, 0) @ net.p["w"] + net.p["b"])
    assert np.allclose(net.probabilities(x, net.tables()), want, atol=1e-4)


# ---- 9 --------------------------------------------------------------------------------------------------


def test_resampling(spark, docs, rows, empty):
    good = [(i, prose(i, 80)) for i in range(200)]
    bad = [(1000 + i, speech(i, "qzxjk#")) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(1000 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    out = resampling.op9(spark.createDataFrame(good + bad, "doc_id long, text string"), labels).collect()
    kept = [r["doc_id"] for r in out if r["kept"]]
    assert len(kept) == 200 and sum(i < 1000 for i in kept) >= 198
    assert resampling.op9(docs, labels).count() == len(rows) and resampling.op9(empty, labels).count() == 0
    assert resampling.op9(docs, labels.limit(0)).count() == len(rows)


def test_token_hashes_tell_tokens_apart():
    h, starts = resampling.token_hashes(b"The the, THE x", resampling._powers(100))
    assert h[0] == h[1] == h[3] and len(set(h.tolist())) == 3 and starts.tolist() == [0, 4, 7, 9, 13]


def test_kth(spark):
    v = np.random.default_rng(1).integers(-(1 << 40), 1 << 40, 300)
    df = spark.createDataFrame([(int(x),) for x in v], "o long")
    for k in (1, 7, 300):
        assert resampling.kth_largest(df, k) == sorted(v.tolist(), reverse=True)[k - 1]
    assert resampling.kth_largest(df, 0) is None and resampling.kth_largest(df, 301) is None


# ---- 10 -------------------------------------------------------------------------------------------------


def test_bpe(docs, rows, empty):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = lib.encode_ordinary(r[1] or "")
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op10(docs).collect())
    assert got == sorted(want) and bpe.op10(empty).count() == 0
    full = bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).filter("id = 13").first()
    assert lib.decode(full["ids"]) == rows[13][1] == bytes(full["decoded"]).decode()


def test_bpe_long_words():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    codec = bpe._codec(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=codec.ranks, special_tokens={})
    rng = np.random.default_rng(8)
    words = ["a" * 700, "".join(rng.choice(list("abcdeé"), 900)), "thethe" * 100, "=" * 2000]
    assert codec.encode_words([w.encode() for w in words]) == [lib.encode_ordinary(w) for w in words]
