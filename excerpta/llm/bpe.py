"""Byte-level BPE encoding and decoding as relational queries.

Each partition runs DuckDB in process. A text is split by the tokenizer's pattern; the distinct words not met
before become rows (word, position, token), one a byte, and a recursive query joins neighbouring rows with
the merge table and contracts the leftmost pair of least rank of every word, until no pair of any word is in
the table. Decoding joins the ids with the vocabulary and aggregates the bytes in order of position.

Such a query keeps about half the square of a word's bytes, so words of more than ``PIECE_BYTES`` run through
it in pieces. A sequence of tokens is a word's encoding if and only if every two neighbours are what their own
bytes encode to: the first contraction over a border would be the first one over it in the two tokens alone
too. So the pieces' borders are checked by encoding the two tokens there, and where they fail a few tokens on
either side are encoded together, twice as many each time, until all borders hold. A stretch that gets very
long that way is periodic; the same step then contracts all equal pairs at once where that is known to give the
same end (if the new token starts or ends no merge of a smaller rank than its own, every pair that the
contraction creates ranks behind those that are left), and keeps only the newest rows.

A cache of bounded size keeps the words that a task has met.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Longest word that is encoded in one piece, bytes of a piece of a longer one, and bytes from which only the newest rows are kept.
PIECE_BYTES, PIECE, LONG_STRETCH = 64, 32, 768
#: Code points of text, rows that a recursive query may keep, words of each half of the cache that a worker holds at a time.
CHUNK_CHARS = 2_000_000
QUERY_ROWS = 2_000_000
CACHE_WORDS = 600_000
CACHE_BORDERS = 400_000
#: Tokens that are decoded as one row.
DECODE_IDS = 4_096

#: One contraction a word and step: the least (rank, place), with the place of the row that it swallows, packed into one number.
_STEPS = """
    with recursive step as (
        select it, word, pos, tok from start_rows
        union all (
            with paired as (select word, pos, tok, lead(tok) over w as nxt, lead(pos) over w as after from step window w as (partition by word order by pos)),
            least as (select word, min((m.merged << 32) | (pos::bigint << 16) | after) as best from paired join pairs m on m.both_ids = ((tok::bigint << 20) | nxt) group by word)
            select (it + 1)::smallint, step.word, pos, case when pos = ((best >> 16) & 65535) then (best >> 32)::int else tok end
            from step join least using (word) where pos <> (best & 65535)))
    select word, tok from step join (select word, max(it) as it from step group by word) using (word, it) order by word, pos
"""
#: All safe contractions of the least pair of one word in a step; rows that are swallowed stay with token -1.
_STRETCH = """
    with recursive step(pos, tok) using key (pos) as (
        select pos, tok from start_rows
        union (
            with paired as (select pos, tok, lead(tok) over (order by pos) as nxt from recurring.step where tok >= 0),
            ranked as (select pos, m.merged, m.alone, row_number() over (order by pos) as spot from paired left join merges m on m.l = tok and m.r = nxt),
            hits as (select pos, spot, merged, alone, spot - row_number() over (order by pos) as run, row_number() over (order by pos) as nth from ranked where merged = (select min(merged) from ranked)),
            taken as (select spot, merged from hits qualify case when alone then nth = 1 else row_number() over (partition by run order by pos) % 2 = 1 end)
            select pos, case when ranked.spot = taken.spot then taken.merged else -1 end
            from taken join ranked on ranked.spot = taken.spot or ranked.spot = taken.spot + 1))
    select 0 as word, tok from step where tok >= 0 order by pos
"""


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, merged, alone) for every way in which a token consists of two. ``alone``: equal pairs must be contracted one at a time."""
    rows = [(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
    early = {x for a, b, r in rows for x in (a, b) if r <= x}
    return pa.table({"l": [a for a, _, _ in rows], "r": [b for _, b, _ in rows], "merged": [r for *_, r in rows], "alone": [r in early for *_, r in rows]})


class Codec:
    """Encodes and decodes words in DuckDB; one a task, so that idle workers, of which an executor may have many, hold none."""

    def __init__(self, path: str):
        self.ranks = vocabulary(path)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("given", merge_rows(self.ranks))
        self.db.execute("create table merges as select * from given")
        self.db.execute("create table pairs as select (l << 20) | r as both_ids, merged from given")
        self.db.unregister("given")
        self.db.register("given", pa.table({"tok": list(self.ranks.values()), "hex": [w.hex() for w in self.ranks]}))
        self.db.execute("create table vocab as select * from given")
        self.db.unregister("given")
        self.tokens = {r: w for w, r in self.ranks.items()}
        self.borders: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def close(self) -> None:
        """Give all memory back."""
        self.db.close()
        for kept in (self.known, self.older, self.borders, self.tokens):
            kept.clear()
        vocabulary.cache_clear()
        _codec.cache_clear()

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (UTF-8)."""
        return [ids.tolist() for ids in self.ids_of(words)]

    def ids_of(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word. A word that is a token has that one id, as the library does it."""
        out = [np.array([self.ranks[w]] if w in self.ranks else [], np.int32) for w in words]
        rest = [i for i, w in enumerate(words) if w and not len(out[i])]
        short = [i for i in rest if len(words[i]) <= PIECE_BYTES]
        for i, ids in zip(short, self.contracted([words[i] for i in short])):
            out[i] = ids
        long = [i for i in rest if len(words[i]) > PIECE_BYTES]
        for i, ids in zip(long, self._by_pieces([words[i] for i in long])):
            out[i] = ids
        return out

    def contracted(self, words: list[bytes]) -> list[np.ndarray]:
        """What the bytes of each word contract to."""
        out = [np.zeros(0, np.int32)] * len(words)
        part, rows = [], 0
        for i in [*sorted(range(len(words)), key=lambda i: len(words[i])), None]:
            if i is None or rows + len(words[i]) ** 2 // 2 > QUERY_ROWS or len(words[i]) > LONG_STRETCH:
                if part:
                    word, tok = self._run(_STEPS, [words[j] for j in part])
                    for j, ids in zip(part, np.split(tok, np.searchsorted(word, np.arange(1, len(part))))):
                        out[j] = ids
                part, rows = [], 0
            if i is not None and len(words[i]) > LONG_STRETCH:
                out[i] = self._run(_STRETCH, [words[i]])[1]
            elif i is not None:
                part.append(i)
                rows += len(words[i]) ** 2 // 2 + 1
        return out

    def _by_pieces(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of long words; pieces of a power of two code points, so that a run of one sign keeps its phase."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        steps = [max(1, 1 << (PIECE * len(t) // len(w)).bit_length() - 1) for t, w in zip(texts, words)]
        pieces = [[t[i : i + n].encode("utf-8", "surrogatepass") for i in range(0, len(t), n)] for t, n in zip(texts, steps)]
        met = list(set().union(*pieces))
        ids_of = dict(zip(met, self.contracted(met)))
        now = [np.concatenate([ids_of[p] for p in ps]) for ps in pieces]
        borders = [np.cumsum([len(ids_of[p]) for p in ps])[:-1] for ps in pieces]
        reach = 2
        while True:
            bad = self._failing(now, borders)
            if not any(map(len, bad)):
                return now
            spans = []
            for k, at in enumerate(bad):
                a, b = np.maximum(at - reach, 0), np.minimum(at + reach, len(now[k]))
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), a[1:] > b[:-1])))
                spans += [(k, int(a[i]), int(b[j - 1])) for i, j in zip(first, [*first[1:], len(a)])]
            joined = [b"".join(map(self.tokens.__getitem__, now[k][a:b].tolist())) for k, a, b in spans]
            met = list(set(joined))
            ids_of = dict(zip(met, self.contracted(met)))
            parts: dict[int, list[tuple[int, int, np.ndarray]]] = {}
            for (k, a, b), t in zip(spans, joined):
                parts.setdefault(k, []).append((a, b, ids_of[t]))
            borders = [np.zeros(0, np.int64)] * len(now)
            for k, found in parts.items():
                made, edges, at, n = [], [], 0, 0
                for a, b, ids in found:
                    made += [now[k][at:a], ids]
                    edges += [n + a - at, n + a - at + len(ids)]
                    n, at = edges[-1], b
                made.append(now[k][at:])
                now[k] = np.concatenate(made)
                borders[k] = np.unique([e for e in edges if 0 < e < len(now[k])]).astype(np.int64)
            reach *= 2

    def _failing(self, now: list[np.ndarray], borders: list[np.ndarray]) -> list[np.ndarray]:
        """The borders where two tokens are not what their bytes encode to."""
        pairs = [list(zip(x[at - 1].tolist(), x[at].tolist())) if len(at) else [] for x, at in zip(now, borders)]
        if len(self.borders) > CACHE_BORDERS:
            self.borders.clear()
        new = list(set().union(*pairs) - self.borders.keys())
        for p, ids in zip(new, self.contracted([self.tokens[a] + self.tokens[b] for a, b in new])):
            self.borders[p] = ids.tolist() == list(p)
        return [at[[not self.borders[p] for p in ps]] if ps else np.zeros(0, np.int64) for at, ps in zip(borders, pairs)]

    def _run(self, query: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.db.register("start_rows", pa.table({"it": np.zeros(len(at), np.int16), "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": at.astype(np.int32), "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]}))
        got = self.db.execute(query).fetchnumpy()
        self.db.unregister("start_rows")
        return np.asarray(got["word"]), np.asarray(got["tok"])

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids."""
        parts = [(w, x[i : i + DECODE_IDS]) for w, x in enumerate(ids) for i in range(0, len(x), DECODE_IDS)]
        out: list[list[bytes]] = [[] for _ in ids]
        for lo in range(0, len(parts), DECODE_IDS):
            some = parts[lo : lo + DECODE_IDS]
            sizes = np.array([len(x) for _, x in some], np.int64)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.db.register("ids", pa.table({"part": np.repeat(np.arange(len(some)), sizes), "pos": at, "tok": np.concatenate([x for _, x in some])}))
            got = self.db.execute("select part, string_agg(hex, '' order by pos) as hex from ids join vocab using (tok) group by part order by part").fetchall()
            self.db.unregister("ids")
            for part, digits in got:
                out[some[part][0]].append(bytes.fromhex(digits))
        return [b"".join(x) for x in out]

    def learn(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers, and decoded bytes, of the words.

        The cache has two halves. A full newer half becomes the older one, and words that are met again move
        to the newer one, so that only words of long ago are forgotten. Long words are not kept.
        """
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        new, long = [], []
        for w in words:
            if w not in self.known:
                if (got := self.older.get(w)) is not None:
                    self.known[w] = got
                else:
                    (long if len(w) > PIECE_BYTES // 2 else new).append(w)
        once: dict[str, tuple[bytes, bytes]] = {}
        for part, into in ((new, self.known), (long, once)):
            at = 0
            while at < len(part):
                end, size = at, 0
                while end < len(part) and size < QUERY_ROWS:
                    size += 4 * len(part[end])
                    end += 1
                ids = self.ids_of([w.encode("utf-8", "surrogatepass") for w in part[at:end]])
                for w, x, raw in zip(part[at:end], ids, self.decode(ids)):
                    into[w] = (x.astype("<u4").tobytes(), raw)
                at = end
        return self.known | once if once else self.known


@lru_cache(2)
def _codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.closing(_codec(path)) as codec:
            yield from of(codec, batches)

    def of(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for b in batches:
            at = 0
            while at < b.num_rows:
                pieces, chars, first = [], 0, at
                while at < b.num_rows and (not chars or chars < CHUNK_CHARS):
                    text = b.column(1)[at].as_py() or ""
                    pieces.append(split.findall(text))
                    chars += len(text) + 1
                    at += 1
                met = set().union(*pieces)
                known = codec.known if codec.known.keys() >= met else codec.learn(met)
                ids, raw = [], []
                for words in pieces:
                    got = [known[w] for w in words]
                    ids.append(b"".join([x[0] for x in got]))
                    raw.append(b"".join([x[1] for x in got]))
                head = b.column(0).slice(first, at - first)
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                    yield pa.RecordBatch.from_arrays([head, n, sha(ids), sha(raw)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([head, n, lists, pa.array(raw, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, path: str, pattern: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_tokens`` and the token ``ids`` and ``decoded`` bytes, or the SHA-256 of both.

    A null text is an empty one and has no ids; repeated rows each have their row; an empty table gives no rows.
    Texts and words may be of any length: a worker holds one text and a bounded number of rows of a query.
    ``path`` is a rank file that every executor can open.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_encode(path, pattern, digests)), "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"))


def op10(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoded(docs, path, pattern or public_tokenizers.PATTERN, digests=True).withColumnRenamed("id", "doc_id")
