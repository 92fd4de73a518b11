"""Quality by importance resampling with hashed n-gram models.

Two generative models over hashed word unigrams and bigrams are counted: one of target text (labelled good
and not toxic, a bounded sample), one of all raw text. A document's log weight is the mean log ratio of its
n-grams, times a fixed number of n-grams, so that length alone decides nothing. Gumbel noise from a hash of
the id turns the top k of the noisy weights into a sample without replacement. k is the share of good rows
among the labelled ones. The k-th key is found exactly by radix selection on the keys' bits, a few counts of
bounded size, without a sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

BUCKETS = 10_000
#: Labelled target documents that the target model is fitted to (those of least hash).
TARGET_DOCS = 20_000
#: n-grams that a weight stands for: larger follows the models more, smaller the noise.
LENGTH = 400.0
SEED = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP_BYTES = 1 << 20
_KIND = np.ones(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32, 0]] = 0
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))))
        down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse))))
    return up, down


def token_hashes(raw: bytes, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the tokens of lower-cased bytes: runs of word bytes, and single marks."""
    b = np.frombuffer(raw.lower(), np.uint8)
    kind = _KIND[b]
    first = kind > 0
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    word_end = np.flatnonzero(np.concatenate((kind[1:] != 1, [True])) & (kind == 1)) + 1
    ends = starts + 1
    ends[kind[starts] == 1] = word_end
    up, down = powers
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
        h = (sums[ends] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h, starts


def _features(texts: list[bytes], powers) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every unigram and bigram; texts are joined by a zero byte, which no bigram crosses."""
    h, starts = token_hashes(b"\0".join(texts), powers)
    edges = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(edges, starts, side="right")
    with np.errstate(over="ignore"):
        two = (h[:-1] * np.uint64(0xFF51AFD7ED558CCD)) ^ h[1:]
        two ^= two >> np.uint64(31)
    same = of[1:] == of[:-1]
    return np.concatenate((of, of[1:][same])), np.concatenate((h % np.uint64(BUCKETS), two[same] % np.uint64(BUCKETS))).astype(np.int64)


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    at, texts, size = 0, [], 0
    for i, cell in enumerate(column):
        texts.append((cell.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(texts[-1]) + 1
        if size >= _STEP_BYTES:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


class _Powers:
    """Powers as long as the longest chunk so far."""

    def __init__(self):
        self.have = _powers(2 * _STEP_BYTES)

    def upto(self, n: int):
        if n >= len(self.have[0]):
            self.have = _powers(2 * n)
        return self.have


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, total = _Powers(), np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        chosen = b.column(1).to_numpy(zero_copy_only=False)
        for at, texts in _chunks(b.column(0)):
            of, bucket = _features(texts, powers.upto(sum(map(len, texts)) + len(texts)))
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[chosen[at + of].astype(bool)], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])


def _score(log_ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            parts = [np.zeros(0)]
            for _, texts in _chunks(b.column(1)):
                of, bucket = _features(texts, powers.upto(sum(map(len, texts)) + len(texts)))
                n = np.bincount(of, minlength=len(texts))
                parts.append(np.bincount(of, log_ratio[bucket], len(texts)) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts))], ["id", "mean"])

    return run


def log_ratios(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of the smoothed models by bucket; zeros without target text. ``targets``: a column ``id``, at most ``TARGET_DOCS`` rows are used."""
    few = targets.select(F.col("id").alias("__t")).filter("__t is not null").distinct().orderBy(F.xxhash64(F.lit(SEED), "__t")).limit(TARGET_DOCS)
    rows = docs.select(F.col(id_col).cast("long").alias("__d"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), F.col("__d") == F.col("__t"), "left")
    counts = rows.select("text", F.col("__t").isNotNull().alias("chosen")).mapInArrow(tidy(_count), "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[r[0]], target[r[0]] = r[1], r[2]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the bigint column ``o``, by counting 4096 digits at a time, or None for k < 1."""
    if k < 1:
        return None
    prefix, shift = 0, 64
    rows = keys.select(F.col("o").bitwiseXOR(F.lit(-(1 << 63))).alias("u"))
    while shift:
        step = min(12, shift)
        shift -= step
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit((1 << step) - 1))
        own = rows if shift + step == 64 else rows.filter(F.shiftrightunsigned("u", shift + step) == F.lit(prefix))
        seen = 0
        for d, n in own.groupBy(digit.alias("d")).count().orderBy(F.desc("d")).collect():
            if seen + n >= k:
                prefix, k = prefix << step | d, k - seen
                break
            seen += n
        else:
            return None
    u = prefix if prefix < 1 << 63 else prefix - (1 << 64)
    return u ^ -(1 << 63)


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """One row per input row: ``id, log_weight, key, kept``.

    ``labels``: doc_id, quality, toxic. A text without n-grams (null, empty) has log weight 0. Rows with equal
    keys (the same id and weight) are kept or left together. ``share`` is the part to keep; by default that
    of labels with quality 1 (everything, if there is none). An empty table gives no rows.
    """
    good = labels.filter("quality = 1")
    if share is None:
        n, m = labels.filter("quality is not null").agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
        share = m / n if m else 1.0
    ratios = log_ratios(docs, good.filter("coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("id")), id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    means = rows.mapInArrow(tidy(_score(ratios)), "id long, mean double")
    draw = (F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    keyed = means.select("id", (F.col("mean") * LENGTH).alias("log_weight"), (F.col("mean") * LENGTH - F.log(-F.log(draw))).alias("key"))
    keyed = cut(keyed.withColumn("o", F.floor(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.col("key"))) * float(1 << 40)).cast("long")))
    least = kth_largest(keyed, round(share * keyed.count()))
    return keyed.select("id", "log_weight", "key", (F.col("o") >= F.lit(least)).alias("kept") if least is not None else F.lit(False).alias("kept"))


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, key, kept of every document."""
    return resampled(docs, labels).withColumnRenamed("id", "doc_id")
