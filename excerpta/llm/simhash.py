"""SimHash near-duplicates found with the binary Golay code.

A document's 64-bit SimHash is cut into three segments of 23, 23 and 18 bits, each a word of the perfect
(23, 12) Golay code's space (the last one padded with zeros). A word lies within 3 bits of exactly one
codeword and, if it lies at 3 bits, within 4 bits of five more. Two words at distance 2 or less always share
a codeword within 4 bits of both: the nearest one to a word midway.

If two fingerprints differ in at most 4 bits, the errors e1 <= e2 <= e3 of their segments have e1 + 2 * e2
<= 4, so either e1 = 0 and e2 <= 2, or e1 = e2 = 1 and e3 <= 2. Each fingerprint therefore gives the keys
* (segment X exactly, codeword near segment Y) for each ordered pair X, Y: at most 36, and
* (codeword near each of the three segments): at most 216, about 150 of 36 bits,
and equal keys bring every pair of linked fingerprints together, whatever the data. All keys are 30 bits and
more, so that groups stay small up to billions of fingerprints. Each candidate is then
verified by counting the differing bits. Only distinct fingerprints are joined, and a key's group gives a
spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parallelism, small, tidy
from .components import connected_components, with_components

SHINGLE = 4
SEED = 42
MAX_DIFFERENT_BITS = 4
#: (first bit, bits) of the three segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code.
GENERATOR = 0b101011100011
_TINY = 6


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included; lower-cased A-Z, fewer words: the whole sequence, none: no hash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    whole = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)][:n], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    parts = map(whole.__getitem__, map(slice, starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n - shingle + 1)


def fingerprint(h: np.ndarray) -> int:
    """SimHash of shingle hashes; of none: 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over word shingles, repeats included; lower-cased A-Z, fewer words: the whole sequence, none: 0."""
    return fingerprint(shingle_hashes(text, shingle))


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word; for each syndrome up to six error patterns, the lightest first; their number."""

    def remainder(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    of_byte = np.array([[remainder(v << 8 * k) if v << 8 * k < 1 << 23 else 0 for v in range(256)] for k in range(3)], np.int64)
    of_bit = [remainder(1 << i) for i in range(23)]
    errors, number = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for i in bits:
                s ^= of_bit[i]
            errors[s, number[s]] = sum(1 << i for i in bits)
            number[s] += 1
    return of_byte, errors, number


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (the 12 message bits) of the codewords within 4 bits of each word, nearest first, and how many there are."""
    of_byte, errors, number = golay()
    s = of_byte[0][words & 255] ^ of_byte[1][words >> 8 & 255] ^ of_byte[2][words >> 16]
    return (words[:, None] ^ errors[s]) >> 11, number[s]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row of ``fps``) for every key of every fingerprint."""
    seg = [(fps >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [near_codewords(x) for x in seg]
    keys, rows, kind = [], [], 0
    slots = np.arange(6)
    for x in range(3):
        for y in range(3):
            if x != y:
                r, c = np.nonzero(slots < near[y][1][:, None])
                keys.append(kind << 50 | seg[x][r] << 12 | near[y][0][r, c])
                rows.append(r)
                kind += 1
    (w0, n0), (w1, n1), (w2, n2) = near
    r, c = np.nonzero(np.arange(216) < (n0 * n1 * n2)[:, None])
    i, rest = c // (n1 * n2)[r], c % (n1 * n2)[r]
    keys.append(kind << 50 | w0[r, i] << 24 | w1[r, rest // n2[r]] << 12 | w2[r, rest % n2[r]])
    rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([simhash64(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], ["id", "text_key", "fp"])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(all_fps), 2048):
            fps = all_fps[i : i + 2048]
            keys, rows = golay_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], ["key", "fp"])


def spanning_links(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one key's fingerprints: breadth first, each found fingerprint leaves the rest."""
    rest, left, right = fps, [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = front[:64]
            front = front[64:]
            hit = np.full(len(rest), -1)
            for a in range(0, len(rest), 65536):
                near = np.bitwise_count(rest[None, a : a + 65536] ^ step[:, None]) <= most
                hit[a : a + 65536] = np.where(near.any(axis=0), near.argmax(axis=0), -1)
            found = hit >= 0
            if found.any():
                left.append(step[hit[found]])
                right.append(rest[found])
                front, rest = np.concatenate((front, rest[found])), rest[~found]
    empty = np.zeros(0, fps.dtype)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _verified_links(most: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            small = np.repeat(sizes <= _TINY, sizes)
            for lag in range(1, _TINY):
                same = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
                same = same[np.bitwise_count(fps[same] ^ fps[same + lag]) <= most]
                left.append(fps[same])
                right.append(fps[same + lag])
            for at, n in zip(starts[sizes > _TINY].tolist(), sizes[sizes > _TINY].tolist()):
                a, b = spanning_links(fps[at : at + n], most)
                left.append(a)
                right.append(b)
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])
            if last or (held and held[-1][0][0] != keys[0]):
                head = [*held, (keys[:last], fps[:last])]
                yield solve(np.concatenate([k for k, _ in head]), np.concatenate([f for _, f in head]))
                held = []
            held.append((keys[last:], fps[last:]))
        if held:
            yield solve(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return links


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key, fp`` (bigint bit pattern) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("text_key")).mapInArrow(tidy(_fingerprints), "id long, text_key long, fp long")


def fingerprint_links(fps: DataFrame, most: int = MAX_DIFFERENT_BITS) -> DataFrame:
    """``a, b``: links (a spanning forest within each key's group) between the distinct values of column ``fp``."""
    if not 0 <= most <= MAX_DIFFERENT_BITS:
        raise ValueError("the keys bring together fingerprints that differ in up to 4 bits")
    keys = fps.select("fp").repartition(parallelism(fps), "fp").mapInArrow(tidy(_emit_keys), "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_verified_links(most)), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DIFFERENT_BITS) -> DataFrame:
    """One row per document: ``id, text_key, fp, component`` (the least id that links lead to, its own included).

    Null texts count as empty; all texts without words have fingerprint zero and link like any other. Repeated
    rows stay repeated. Rows whose id is null keep their row; a component of null ids only has a null component.
    """
    prints = cut(simhash_fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    named = with_components(distinct, connected_components(fingerprint_links(distinct, most)), "fp")
    return prints.join(named, "fp", "left").select("id", "text_key", "fp", "component")


def least_of_each(docs: DataFrame, own: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the least of their component in ``own`` (``id, text_key, component``), with all their columns.

    ``text_key`` tells rows that share an id apart: each is judged by its own component, so that no text is lost
    for the sake of another with its id. Rows equal in id and text are one row. Rows without an id stay.
    """
    keyed = docs.withColumn("__key", text_key(text_col))
    named = own.filter("id is not null")
    same = lambda k: (F.col(id_col) == F.col(f"__{k}")) & (F.col("__key") == F.col(f"__{k}_key"))
    rows = lambda df, k: small(cut(df.select(F.col("id").alias(f"__{k}"), F.col("text_key").alias(f"__{k}_key")).distinct()), 16)
    kept = keyed.join(rows(named.filter("id <> component"), "gone"), same("gone"), "left_anti")
    twice = rows(named.groupBy("id", "text_key").count().filter("count > 1"), "twice")
    once = kept.join(twice, same("twice"), "left_semi").dropDuplicates([id_col, "__key"])
    return kept.join(twice, same("twice"), "left_anti").unionByName(once).select(*docs.columns)


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DIFFERENT_BITS) -> DataFrame:
    """The least document of each component, with all columns; see ``least_of_each``."""
    return least_of_each(docs, simhash_components(docs, id_col, text_col, most), id_col, text_col)


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    return simhash_components(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
