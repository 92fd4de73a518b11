"""op9_importance_resampling against plain loops: models, weights, noise and the kept rows."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from excerpta.llm import resampling

MASK = (1 << 64) - 1


def token_hash(raw):
    h = sum((b + 1) * pow(int(resampling._BASE), i, 1 << 64) for i, b in enumerate(raw)) & MASK
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & MASK
    return h ^ h >> 32


def ngrams(text):
    """Buckets of the words, single marks and pairs of neighbours of a text."""
    raw = (text or "").encode().lower()
    tokens = [token_hash(t) for t in re.findall(rb"[0-9a-z\x01-\x08\x0e-\x1f\x7f-\xff]+|[!-/:-@\[-`{-~]", raw)]
    pairs = []
    for a, b in zip(tokens, tokens[1:]):
        two = a * 0xFF51AFD7ED558CCD & MASK ^ b
        pairs.append(two ^ two >> 31)
    return [x % resampling.BUCKETS for x in tokens + pairs]


def test_against_loops(spark):
    rng = np.random.default_rng(5)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    texts = [" ".join(rng.choice(good if i % 3 else bad, int(rng.integers(1, 60)))) + ("!" if i % 2 else "") for i in range(150)]
    texts += [None, "", "Größe 日本語", texts[0], "x" * 5000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id")]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 1)) for i in range(0, 150, 2)] + [(149, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "key": F.lit(1), "bucket": F.lit(2)})
    got = resampling.op9(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    target_ids = {i for i, q, x in labels if q == 1 and not x}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(ngrams(t))
        if i in target_ids:
            target.update(ngrams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log((target[b] + 1) / (n_target + resampling.BUCKETS)) - math.log((raw[b] + 1) / (n_raw + resampling.BUCKETS))
    drawn = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(resampling.SEED), "doc_id"), F.lit(1 << 40))).distinct().collect()}
    want = []
    for i, t in rows:
        grams = ngrams(t)
        weight = resampling.LENGTH * sum(map(ratio, grams)) / len(grams) if grams else 0.0
        want.append((i, weight, weight - math.log(-math.log((drawn[i] + 0.5) / (1 << 40)))))
    key = lambda r: (str(r[0]), r[1])
    have = sorted(((r["doc_id"], r["log_weight"], r["key"], r["kept"]) for r in got), key=key)
    want.sort(key=key)
    assert [h[0] for h in have] == [w[0] for w in want]
    assert np.allclose([h[1:3] for h in have], [w[1:] for w in want])
    known = [q for _, q, _ in labels if q is not None]
    least = sorted((w[2] for w in want), reverse=True)[round(len(rows) * sum(known) / len(known)) - 1]
    assert [h[3] for h in have] == [w[2] >= least - 1e-9 for w in want]
    assert resampling.op9(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
