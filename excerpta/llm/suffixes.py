"""Exact removal of repeated byte strings with suffix arrays built by linear grouping.

A byte goes if a 50-byte string that covers it also starts in a document of smaller id. Every 50-byte string
has an anchor: the 32-byte string of least hash among the 19 that it holds. Equal strings have equal anchors
at equal places, so only anchors that occur in two documents matter. Around each of those, 18 bytes on either
side hold every 50-byte string with that anchor. Occurrences with the same bytes around are one, known by its
least document. The strings that begin 0 to 9 bytes before an anchor, and those that begin 10 to 18 before it, are
compared by themselves: what is left to compare is written as the 9 or 8 bytes before the string that begins last and
one symbol for that string, named in the order of such strings. A suffix array over all of it brings equal strings
together, as suffixes with the same bytes before are ordered by what follows. The answers return to the documents as
bits of the starts around each anchor.

The suffix array is built without recursion or renaming: suffixes are grouped by their longest Lyndon prefix,
groups taken in descending order, each suffix pointing to the nearest suffix before it of a smaller group and
lifting that one in its own group by how often it is pointed to; then one pass over the array being filled
places each suffix at the front of its group.

Equal texts are one text, known by a 64-bit hash that is checked to tell all texts apart: of each, one row
carries it, compressed, to where its answers come; the other rows carry their lengths only. Copies lose every
byte if they are long enough to hold a string. Anchors, contexts and answers travel in packed blocks by anchor
hash, one bucket a task. Long texts are worked on in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, text_or_empty, tidy

LENGTH, GRAM = 50, 32
SIDE = LENGTH - GRAM
#: Symbols that one suffix array takes. More contexts of one anchor are told apart by more of their bytes first.
ARRAY_SYMBOLS = 200_000
#: Texts with an anchor beyond which its contexts are dealt by the bytes on either side too.
HOT_TEXTS = 20_000
#: Bytes of a long text whose anchors are sought at a time.
STRETCH = 4_000_000
#: Bytes of a hash that are sent to find repeated anchors, besides its bucket. Chance matches only add work.
TOKEN_BYTES = 4
#: Bytes of text, and documents, that a task packs together.
PACK_BYTES, PACK_DOCS = 16_000_000, 60_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_LAST = (1 << 63) - 1


def _slide(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over every n consecutive values."""
    w = 1
    while 2 * w <= n:
        a = f(a[:-w], a[w:])
        w *= 2
    return f(a[: len(a) - (n - w)], a[n - w :]) if w < n else a


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors. Of equal hashes in one string all count."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo in range(0, len(b), STRETCH):
        # every string that holds a place of this stretch lies between these ends
        start = max(0, lo - SIDE)
        at, h = _anchors(b[start : lo + STRETCH + LENGTH - 1])
        own = (at + start >= lo) & (at + start < lo + STRETCH)
        places.append(at[own] + start)
        hashes.append(h[own])
    return np.concatenate(places), np.concatenate(hashes)


def _anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(b) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = np.ascontiguousarray(b)
    word = np.lib.stride_tricks.as_strided(b, (len(b) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    n = len(b) - GRAM + 1
    with np.errstate(over="ignore"):
        h = word[:n] * _MIX[0]
        for k in range(1, GRAM // 8):
            h ^= h >> np.uint64(29)
            h += word[8 * k : 8 * k + n]
            h *= _MIX[k]
        h ^= h >> np.uint64(32)
    least = _slide(h, SIDE + 1, np.minimum)
    pad = np.zeros(SIDE, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), SIDE + 1, np.maximum) == h)
    return at, h[at]


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of a list of non-negative symbols whose last one is the only least one."""
    n = len(s)
    symbols = np.asarray(s, np.int64)
    order = np.argsort(symbols, kind="stable")
    first = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1]))
    starts = np.flatnonzero(first)
    of_row = np.repeat(starts, np.diff(np.append(starts, n)))
    group = np.empty(n, np.int64)
    group[order] = of_row
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    size_at = np.zeros(n, np.int64)
    size_at[starts] = np.diff(np.append(starts, n))
    rows, group, place, size = order.tolist(), group.tolist(), place.tolist(), size_at.tolist()
    before = [-1] * n
    end = n - 1
    while end > 0:
        start = group[rows[end]]
        if start == end:
            i = rows[end]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = group[j]
                e = g + size[g] - 1
                if e > g:
                    p, q = place[j], rows[e]
                    rows[p], rows[e] = q, j
                    place[q], place[j] = p, e
                    size[g] = e - g
                    group[j] = e
                    size[e] = 1
        else:
            pointed: dict[int, int] = {}
            for i in sorted(rows[start : end + 1]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, list[int]] = {}
            for j, c in pointed.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                lifted: dict[int, list[int]] = {}
                for j in by_count[c]:
                    g = group[j]
                    e = g + size[g] - 1
                    p, q = place[j], rows[e]
                    rows[p], rows[e] = q, j
                    place[q], place[j] = p, e
                    size[g] = e - g
                    lifted.setdefault(g, []).append(j)
                for g, js in lifted.items():
                    new = g + size[g]
                    size[new] = len(js)
                    for j in js:
                        group[j] = new
        end = start - 1
    out = [-1] * n
    front = list(range(n))
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            f = front[g]
            out[f] = j
            front[g] = f + 1
            placed[j] = 1
            j = before[j]
    return out


def _earliest_by_array(token: np.ndarray, name: np.ndarray, ctx: np.ndarray, doc: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For each context and each of its strings that begin lo..hi bytes before the anchor, hi first, the least document that has the string.

    A context is written as the bytes before its string at ``lo`` and one symbol for that string, ``name``. Names ascend
    in the order of tokens and strings, so that strings of one token with the same beginning stay neighbours.
    """
    m, width = len(ctx), hi - lo + 1
    body = np.empty((m, width), np.int64)
    body[:, :-1] = ctx[:, SIDE - hi : SIDE - lo]
    body[:, -1] = name + 300
    order = np.asarray(suffix_array(np.append(body.ravel(), 0).tolist()), np.int64)
    order = order[order < m * width]
    row, at = order // width, order % width
    string = ctx[row[:, None], (SIDE - hi + at)[:, None] + np.arange(SIDE)]
    new = (string[1:] != string[:-1]).any(axis=1) | (token[row[1:]] != token[row[:-1]]) | (at[1:] != at[:-1])
    new = np.concatenate(([True], new))
    out = np.empty((m, width), np.int64)
    out[row, at] = np.minimum.reduceat(doc[row], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _earliest(token: np.ndarray, ctx: np.ndarray, doc: np.ndarray, lo: int = 0, hi: int = SIDE) -> np.ndarray:
    """For each context, the least document that has each of its strings that begin lo..hi bytes before the anchor, hi first.

    The string that begins ``l`` bytes before the anchor needs those bytes and the ``SIDE - l`` after it. Each half of
    the ``l`` is worked on by itself: contexts that differ elsewhere are one, those that share too little with any
    other one of their anchor have such strings for themselves, the others go to suffix arrays. Too many that share
    what all strings of the half share are told apart for half of its ``l`` at a time.
    """
    out = np.empty((len(ctx), hi - lo + 1), np.int64)
    mid = (lo + hi) // 2
    for a, b in [(lo, lo)] if lo == hi else [(lo, mid), (mid + 1, hi)]:
        columns = np.concatenate((np.arange(SIDE - a, 2 * SIDE - a), np.arange(SIDE - b, SIDE - a)))
        key = np.concatenate((token[:, None].astype(np.int64).view(np.int16).reshape(len(ctx), 4), ctx[:, columns]), axis=1)
        _, first, of = np.unique(key.view([("", f"V{key.shape[1] * 2}")]).ravel(), return_index=True, return_inverse=True)
        of = of.ravel()
        least = np.full(len(first), _LAST)
        np.minimum.at(least, of, doc)
        key, rows = key[first], ctx[first]
        found = np.repeat(least[:, None], b - a + 1, axis=1)
        if a < b:
            differs = key[1:] != key[:-1]
            shared = 4 + SIDE - (b - a)  # the token and what all strings of this half have in common
            group = np.concatenate(([0], np.cumsum(differs[:, :shared].any(axis=1))))
            name = np.concatenate(([0], np.cumsum(differs[:, : 4 + SIDE].any(axis=1))))
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            ends = np.append(edges[1:], len(group))
            some = ends - edges > 1
            many = some & ((ends - edges) * (b - a + 1) > ARRAY_SYMBOLS)
            for x, y in zip(edges[many], ends[many]):
                found[x:y] = _earliest(group[x:y], rows[x:y], least[x:y], a, b)
            pick = np.flatnonzero(np.repeat(some & ~many, ends - edges))
            stops = np.cumsum((ends - edges)[some & ~many])
            x = 0
            while x < len(pick):
                y = stops[np.searchsorted(stops, x + ARRAY_SYMBOLS // (b - a + 1), "right") - 1]
                p = pick[x:y]
                found[p] = _earliest_by_array(group[p], name[p] - name[p[0]], rows[p], least[p], a, b)
                x = y
        out[:, hi - b : hi - a + 1] = found[of]
    return out


def _pack(*parts: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _emit_anchors(n_buckets: int):
    """(bucket, n, docs, block): the low bytes of the hashes text by text, how many each text has, the texts' own hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        met: set[int] = set()
        hashes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            of = np.repeat(np.arange(len(keys)), [len(x) for x in hashes])
            b = _buckets(h, n_buckets)
            order = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[order], np.arange(n_buckets + 1))
            rids = np.array(keys, np.int64)
            rows = []
            for k in np.flatnonzero(np.diff(cuts)):
                pick = order[cuts[k] : cuts[k + 1]]
                edges = np.flatnonzero(np.concatenate(([True], of[pick][1:] != of[pick][:-1])))
                docs, sizes = of[pick][edges], np.diff(np.append(edges, len(pick)))
                low = h[pick].view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
                raw = b"".join((low.tobytes(), rids[docs].tobytes(), _narrow(sizes)))
                rows.append((int(k), len(pick), len(docs), raw))
            keys.clear()
            met.clear()
            hashes.clear()
            size = 0
            return pa.RecordBatch.from_pylist([dict(zip(("bucket", "n", "docs", "block"), r)) for r in rows], schema=pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("docs", pa.int32()), ("block", pa.binary())]))

        for batch in batches:
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in met:
                    continue
                b = np.frombuffer(cell.as_buffer() or b"", np.uint8) if cell.is_valid else np.zeros(0, np.uint8)
                _, h = anchors(b)
                if len(h):
                    keys.append(key)
                    met.add(key)
                    hashes.append(np.unique(h))
                    size += len(b)
                    if size >= PACK_BYTES or len(keys) >= PACK_DOCS:
                        yield flush()
        if keys:
            yield flush()

    return run


def _narrow(sizes: np.ndarray) -> bytes:
    """Counts, a byte each, those of 255 and more as four bytes at the end."""
    return np.minimum(sizes, 255).astype(np.uint8).tobytes() + sizes[sizes >= 255].astype(np.int32).tobytes()


def _widened(raw: bytes, m: int, at: int) -> np.ndarray:
    sizes = np.frombuffer(raw, np.uint8, m, at).astype(np.int64)
    full = sizes == 255
    sizes[full] = np.frombuffer(raw, np.int32, int(full.sum()), at + m)
    return sizes


def _repeated(hot_texts: int):
    """Blocks of a bucket in; (rid, h) of the anchors that two texts have. h is the bucket and the low bytes, inverted for anchors of more than ``hot_texts`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                k, n, m = (batch.column(i)[r].as_py() for i in range(3))
                raw = batch.column(3)[r].as_py()
                low = np.zeros((n, 8), np.uint8)
                low[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8, TOKEN_BYTES * n).reshape(n, TOKEN_BYTES)
                rids = np.repeat(np.frombuffer(raw, np.int64, m, TOKEN_BYTES * n), _widened(raw, m, (TOKEN_BYTES * n) + 8 * m))
                blocks.setdefault(k, []).append((low.view(np.uint64).ravel(), rids))
        for k in list(blocks):
            t, d = (np.concatenate(x) for x in zip(*blocks.pop(k)))
            order = np.argsort(t, kind="stable")
            t, d = t[order], d[order]
            at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            two = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
            sizes = np.diff(np.append(at, len(t)))
            keep, hot = np.repeat(two, sizes), np.repeat(sizes > hot_texts, sizes)
            h = (np.int64(k) << 8 * TOKEN_BYTES) | t.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(np.where(hot, ~h, h)[keep])], ["rid", "h"])

    return run


def _distinct(h: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct contexts, and the number of each one's."""
    row = np.concatenate((h.view(np.uint8).reshape(-1, 8), ctx.view(np.uint8).reshape(len(ctx), -1)), axis=1)
    _, first, of = np.unique(np.ascontiguousarray(row).view([("", f"V{row.shape[1]}")]).ravel(), return_index=True, return_inverse=True)
    return first, of.ravel()


def _inside(ctx: np.ndarray) -> np.ndarray:
    """Which strings of a context do not reach over an end of the text."""
    out = np.ones((len(ctx), SIDE + 1), bool)
    for j in range(SIDE + 1):
        out[:, j] = (ctx[:, j : SIDE + j] != 299).all(axis=1)
    return out


def _bits(some: np.ndarray) -> np.ndarray:
    return (some << np.arange(SIDE + 1)).sum(axis=1).astype(np.int32)


_HALF = (SIDE + 1) // 2


def _by_sides(h: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Other hashes for contexts of a hot anchor: with the bytes before it that the strings of half of the places share, and with those after it."""
    out = []
    with np.errstate(over="ignore"):
        for part in (ctx[:, _HALF:SIDE], ctx[:, SIDE : SIDE + _HALF + 1]):
            x = h ^ _MIX[1]
            for c in part.T:
                x = (x ^ c.astype(np.uint64)) * _MIX[0]
                x ^= x >> np.uint64(31)
            out.append(x)
    return out[0], out[1]


def _emit_contexts(n_buckets: int):
    """(bucket, n, block) for documents with repeated anchors: hashes, keys, places and the bytes around; or, n negative, answers.

    Of equal contexts in a block only those of its least document are sent on: every string of the others starts
    in that one. So a passage that very many documents share comes to its bucket once a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        unzip = zstandard.ZstdDecompressor()

        def flush() -> pa.RecordBatch:
            nonlocal size
            h, key, rid, at, ctx, hot = (np.concatenate([x[i] for x in held]) for i in range(6))
            held.clear()
            size = 0
            first, of = _distinct(h, ctx)
            least = np.full(len(first), _LAST)
            np.minimum.at(least, of, key)
            later = key > least[of]
            rows = []
            if later.any():
                bits = _bits(_inside(ctx[later]))
                rows.append({"bucket": int(rid[0]) % n_buckets, "n": -len(bits), "block": _pack(rid[later], at[later].astype(np.int32), bits)})
            h, key, rid, at, ctx, hot = (x[~later] for x in (h, key, rid, at, ctx, hot))
            part = np.zeros(len(h), np.int8)
            if hot.any():
                sides = _by_sides(h[hot], ctx[hot])
                part = np.concatenate((part[~hot], np.repeat(np.array([1, 2], np.int8), hot.sum())))
                h = np.concatenate((h[~hot], *sides))
                key, rid, at, ctx = (np.concatenate((x[~hot], x[hot], x[hot])) for x in (key, rid, at, ctx))
            b = _buckets(h, n_buckets)
            order = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[order], np.arange(n_buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                p = order[cuts[k] : cuts[k + 1]]
                rows.append({"bucket": int(k), "n": len(p), "block": _pack(h[p], key[p], rid[p], at[p].astype(np.int32), ctx[p], part[p])})
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("block", pa.binary())]))

        for batch in batches:
            for rid, key, z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                b = np.frombuffer(unzip.decompress(z.as_py()), np.uint8)
                at, h = anchors(b)
                own = (_buckets(h, n_buckets) << 8 * TOKEN_BYTES) | (h & np.uint64((1 << 8 * TOKEN_BYTES) - 1)).astype(np.int64)
                wanted = wanted.values.to_numpy()
                sought = np.sort(np.where(wanted < 0, ~wanted, wanted))
                take = sought[np.minimum(np.searchsorted(sought, own), len(sought) - 1)] == own
                at, h, own = at[take], h[take], own[take]
                if not len(at):
                    continue
                # bytes outside of the text are a symbol of their own, 256 + 1 here and in the array
                wide = np.concatenate((np.full(SIDE, 299, np.int16), b.astype(np.int16) + 2, np.full(SIDE, 299, np.int16)))
                around = np.concatenate((np.arange(SIDE), np.arange(SIDE + GRAM, LENGTH + SIDE)))
                hot = ~wanted[wanted < 0]
                held.append((h, np.full(len(at), key), np.full(len(at), rid), at, wide[at[:, None] + around], np.isin(own, hot) if len(hot) else np.zeros(len(at), bool)))
                size += len(at) * 2 * SIDE
                if size >= PACK_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def _solve(h: np.ndarray, key: np.ndarray, rid: np.ndarray, at: np.ndarray, ctx: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, bits) of the occurrences with a string that starts in an earlier document. ``part``: which half of the places counts, or 0."""
    first, of = _distinct(h, ctx)
    least = np.full(len(first), _LAST)
    np.minimum.at(least, of, key)
    dh, dctx = h[first], ctx[first]
    order = np.argsort(dh, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], dh[order][1:] != dh[order][:-1])))
    token = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    earliest = np.empty((len(first), SIDE + 1), np.int64)
    earliest[order] = _earliest(token, dctx[order], least[order])
    hit = (earliest[of] < key[:, None]) & _inside(dctx)[of]
    hit[part == 1, _HALF + 1 :] = False
    hit[part == 2, : _HALF + 1] = False
    some = hit.any(axis=1)
    return rid[some], at[some], _bits(hit[some])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a bucket in; the answers of its anchors."""
    unzip = zstandard.ZstdDecompressor()
    blocks: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            n = batch.column(1)[r].as_py()
            raw = unzip.decompress(batch.column(2)[r].as_py())
            if n < 0:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64, -n)), *[pa.array(np.frombuffer(raw, np.int32, -n, -k * n)) for k in (8, 12)]], ["rid", "at", "bits"])
                continue
            blocks.setdefault(batch.column(0)[r].as_py(), []).append((np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.int64, n, 16 * n), np.frombuffer(raw, np.int32, n, 24 * n), np.frombuffer(raw, np.int16, n * 2 * SIDE, 28 * n).reshape(n, 2 * SIDE), np.frombuffer(raw, np.int8, n, (28 + 4 * SIDE) * n)))
    for k in list(blocks):
        rid, at, bits = _solve(*(np.concatenate(x) for x in zip(*blocks.pop(k))))
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(at.astype(np.int32)), pa.array(bits)], ["rid", "at", "bits"])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([zip_.compress(x.as_buffer() or b"") for x in b.column(2)], pa.binary())], ["rid", "key", "z"])


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places (exclusive) of the bytes that strings at these sorted starts cover."""
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + LENGTH))[: len(starts)])
    return starts[first], np.append(starts[first[1:] - 1], starts[-1:]) + LENGTH


def _finish(with_text: bool):
    """What is left of each text by its answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for rid, least, z, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = unzip.decompress(z.as_py())
                starts = np.zeros(0, np.int64)
                if marks.is_valid:
                    at, bits = marks.values.field(0).to_numpy(), marks.values.field(1).to_numpy()
                    r, j = np.nonzero(bits[:, None] >> np.arange(SIDE + 1) & 1)
                    starts = np.unique(at[r] - SIDE + j)
                a, b = _runs(starts)
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
                row = {"rid": rid, "least": least, "n_removed": len(raw) - len(kept), "n_spans": len(a), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                out.append(row | {"kept": kept} if with_text else row)
            fields = [("rid", pa.int64()), ("least", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*fields, *[("kept", pa.binary())] * with_text]))

    return run


def named_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with a bigint ``rid`` for column ``text``: equal texts have equal ones, others different ones.

    A 64-bit hash, checked against a second one. Texts that share the first with another text (about the
    square of the number of texts divided by 2^65: none in most corpora, three of 10^10) take the second.
    """
    clashing: list[int] = []
    while True:
        one, two = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
        rid = F.when(one.isin(clashing), two).otherwise(one) if clashing else one
        named = rows.withColumn("rid", rid)
        more = [r[0] for r in named.select("rid", two.alias("h")).groupBy("rid").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("rid").collect()]
        if not more:
            return named
        clashing += more


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, the ``kept`` bytes.

    Null texts are empty. Rows that share an id have nothing removed for each other's sake. A null id counts as
    greater than all others. Texts shorter than the string length stay whole. An empty table gives no rows. A
    task holds one text at a time and about fifty bytes for each byte of a stretch of it.
    """
    n = parallelism(docs)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    rows = named_texts(docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), text_or_empty(text_col).alias("text")))
    blocks = rows.select("rid", F.col("text").cast("binary")).mapInArrow(tidy(_emit_anchors(n)), "bucket int, n int, docs int, block binary")
    repeated = blocks.repartitionById(n, "bucket").mapInArrow(tidy(_repeated(hot_texts)), "rid long, h long")
    wanted = repeated.groupBy("rid").agg(F.collect_list("h").alias("wanted"))
    # one row a text; both joins below read the one shuffle of it
    texts = rows.select("rid", "key", F.col("text").cast("binary")).mapInArrow(tidy(_compress), "rid long, key long, z binary").groupBy("rid").agg(F.min("key").alias("least"), F.first("z").alias("z"))
    around = texts.join(wanted, "rid").select("rid", "least", "z", "wanted").mapInArrow(tidy(_emit_contexts(n)), "bucket int, n int, block binary")
    answers = around.repartitionById(n, "bucket").mapInArrow(tidy(_answers), "rid long, at int, bits int")
    marks = answers.groupBy("rid").agg(F.collect_list(F.struct("at", "bits")).alias("marks"))
    schema = "rid long, least long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    of_text = texts.join(marks, "rid", "left").select("rid", "least", "z", "marks").mapInArrow(tidy(_finish(with_text)), schema)
    light = rows.select("id", "key", "rid", F.octet_length("text").cast("long").alias("n_bytes"))
    # every string of a later copy starts in the first row with its text
    gone = (F.col("key") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    pick = lambda c, other: F.when(gone, other).otherwise(F.col(c)).alias(c)
    out = [pick("n_removed", F.col("n_bytes")), pick("n_spans", F.lit(1).cast("long")), pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()))]
    return light.join(of_text, "rid").select("id", "n_bytes", *out, *[pick("kept", F.lit(b""))] * with_text)


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs).withColumnRenamed("id", "doc_id")
