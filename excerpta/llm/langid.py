"""Language identification by a byte convolutional network.

Bytes are embedded, convolved with filters of widths 2, 3 and 4, max-pooled over a window of 256 bytes and
classified by a softmax layer. The network is trained in numpy on a bounded sample of labelled windows. A
text is cut into windows from its first byte to its last, all of them are scored in batches, and the mean of
their class probabilities decides. For prediction the embedding and the filters are folded into tables over
bytes and byte pairs, so a convolution is a few look-ups and additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy
from pyspark.sql.types import BooleanType, StructField, StructType

#: Bounds of the training sample: languages (the commonest ones), documents a language, windows a document.
TRAIN_LANGS = 256
TRAIN_DOCS = 400
TRAIN_WINDOWS = 6
WINDOW_BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS = 24
EMBEDDED = 8
STEPS = 500
BATCH = 64
SEED = 7
NONE = "und"
_STEP_WINDOWS = 64


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(lang, piece of text) of the documents of least hash in each language, none of them held out. Bounded by the parameters above.

    The documents of a language are counted first (distinct hashes, approximately); only those whose hash is
    small enough for half as many again as are wanted are gathered. Rows equal in id and text are one.
    """
    h = F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col).cast("string"))
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held"), h.alias("h"))
    rows = rows.filter(~F.col("held") & F.col("lang").isNotNull() & (F.length("text") > 0))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("distinct")).orderBy(F.desc("n"), "lang").limit(TRAIN_LANGS).collect()
    if not found:
        return []
    most = [(r["lang"], -(1 << 63) + min((1 << 64) - 1, int((1.5 * TRAIN_DOCS + 50) / max(1, r["distinct"]) * (1 << 32)) << 32)) for r in found]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(most, "l string, most long"))
    at = lambda k: F.pmod(F.xxhash64("h", k), F.greatest(F.length("text") - WINDOW_BYTES, F.lit(1))).cast("int")
    few = F.least(F.lit(TRAIN_WINDOWS), 1 + F.floor(F.length("text") / WINDOW_BYTES)).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), few), lambda k: F.substring("text", at(k) + 1, F.lit(WINDOW_BYTES)))
    near = rows.join(bounds, (F.col("lang") == F.col("l")) & (F.col("h") <= F.col("most")))
    near = near.select("lang", "h", pieces.alias("pieces")).groupBy("lang", "h").agg(F.first("pieces").alias("pieces"))
    taken: dict[str, int] = {}
    out = []
    for lang, _, texts in sorted(map(tuple, near.collect())):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= TRAIN_DOCS:
            out += [(lang, t) for t in texts]
    return out


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text's bytes, the last one padded with zero bytes; an empty text has one window."""
    n = max(1, -(-len(raw) // WINDOW_BYTES))
    return np.frombuffer(raw.ljust(n * WINDOW_BYTES, b"\0"), np.uint8).reshape(n, WINDOW_BYTES)


class ByteConvNet:
    """The network's parameters, training and table look-ups."""

    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDED)), "w": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))), "b": np.zeros(len(classes))}
        for k in WIDTHS:
            self.p[f"f{k}"] = rng.normal(0, (k * EMBEDDED) ** -0.5, (k * EMBEDDED, FILTERS))
            self.p[f"c{k}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.01) -> None:
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            for k, g in self.gradients(x[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        e = self.p["e"][x]
        pooled, best = [], []
        for k in WIDTHS:
            patch = np.concatenate([e[:, i : WINDOW_BYTES - k + 1 + i] for i in range(k)], axis=2)
            a = patch @ self.p[f"f{k}"]
            best.append(a.argmax(axis=1))
            pooled.append(np.take_along_axis(a, best[-1][:, None], 1)[:, 0] + self.p[f"c{k}"])
        h = np.concatenate(pooled, axis=1)
        r = np.maximum(h, 0)
        d = softmax(r @ self.p["w"] + self.p["b"])
        d[np.arange(n), y] -= 1
        d /= n
        g = {"w": r.T @ d, "b": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (d @ self.p["w"].T) * (h > 0)
        for j, k in enumerate(WIDTHS):
            dk = dh[:, j * FILTERS : (j + 1) * FILTERS]
            at = best[j][:, :, None] + np.arange(k)
            seen = x[np.arange(n)[:, None, None], at]
            g[f"c{k}"] = dk.sum(axis=0)
            g[f"f{k}"] = np.einsum("nf,nfe->ef", dk, self.p["e"][seen].reshape(n, FILTERS, -1))
            back = dk[:, :, None, None] * self.p[f"f{k}"].T.reshape(FILTERS, k, EMBEDDED)[None]
            np.add.at(g["e"], seen.ravel(), back.reshape(-1, EMBEDDED))
        return g

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width, tables (place in the patch, over byte pairs or single bytes) whose look-ups sum to the filters' outputs."""
        out = {}
        for k in WIDTHS:
            part = [(self.p["e"] @ self.p[f"f{k}"][i * EMBEDDED : (i + 1) * EMBEDDED]).astype(np.float32) for i in range(k)]
            out[k] = [(i, (part[i][:, None] + part[i + 1][None]).reshape(65536, FILTERS)) for i in range(0, k - 1, 2)]
            if k % 2:
                out[k].append((k - 1, part[-1]))
        return out

    def probabilities(self, x: np.ndarray, tables: dict[int, list[tuple[int, np.ndarray]]]) -> np.ndarray:
        """Class probabilities of windows."""
        pair = x[:, :-1].astype(np.intp) << 8 | x[:, 1:]
        h = []
        for k in WIDTHS:
            n = WINDOW_BYTES - k + 1
            a = None
            for i, t in tables[k]:
                got = t[(pair if len(t) > 256 else x)[:, i : i + n]]
                a = got if a is None else np.add(a, got, out=a)
            h.append(a.max(axis=1) + self.p[f"c{k}"])
        return softmax(np.maximum(np.concatenate(h, axis=1), 0) @ self.p["w"] + self.p["b"])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(pieces: list[tuple[str, str]]) -> ByteConvNet | None:
    """A network fitted to (lang, piece of text) rows; None without rows."""
    classes = sorted({lang for lang, _ in pieces})
    if not classes:
        return None
    net = ByteConvNet(classes)
    number = {c: i for i, c in enumerate(classes)}
    x = np.stack([windows_of(t.encode("utf-8", "surrogatepass")[:WINDOW_BYTES])[0] for _, t in pieces])
    y = np.array([number[lang] for lang, _ in pieces])
    # classes weigh alike: each is repeated to about the size of the largest
    most = np.bincount(y).max()
    rows = np.concatenate([np.resize(np.flatnonzero(y == c), most) for c in range(len(classes))])
    if len(classes) > 1:
        net.fit(x[rows], y[rows])
    return net


@lru_cache(1)
def _tables_of(key: bytes):
    import pickle

    net = pickle.loads(key)
    return net, net.tables()


def _predict(net: ByteConvNet | None):
    import pickle

    key = pickle.dumps(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = _tables_of(key) if net else (None, None)
        for b in batches:
            n = b.num_rows
            lang, score = [NONE] * n, np.zeros(n)
            total = np.zeros((n, len(own.classes) if own else 1))
            count = np.zeros(n)
            held: list[np.ndarray] = []
            rows: list[np.ndarray] = []
            waiting = 0

            def flush() -> None:
                nonlocal waiting
                x, at = np.concatenate(held), np.concatenate(rows)
                for i in range(0, len(x), _STEP_WINDOWS):
                    np.add.at(total, at[i : i + _STEP_WINDOWS], own.probabilities(x[i : i + _STEP_WINDOWS], tables))
                held.clear()
                rows.clear()
                waiting = 0

            for i, cell in enumerate(b.column(1)):
                text = cell.as_py()
                if own and text and any(map(str.isalpha, text)):
                    w = windows_of(text.encode("utf-8", "surrogatepass"))
                    held.append(w)
                    rows.append(np.full(len(w), i))
                    count[i] = len(w)
                    waiting += len(w)
                    if waiting >= 32 * _STEP_WINDOWS:
                        flush()
            if held:
                flush()
            for i in np.flatnonzero(count):
                best = int(total[i].argmax())
                lang[i], score[i] = own.classes[best], min(1.0, float(total[i, best] / count[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row; ``und`` and 0 where the text is null or has no letter, or nothing was learned.

    Of languages with equal scores the first by code point is taken. Repeated rows each have their row, an
    empty table gives none. A text is cut into windows as a whole; a step holds 64 of them.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_predict(net)), "id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, all columns, whose language is recognised with at least the given score."""
    from .common import fresh

    net = train(training_windows(docs, id_col, text_col, lang_col))
    flag, names = fresh("keep"), docs.columns
    run = _predict(net)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            (found,) = run([pa.RecordBatch.from_arrays([b.column(at), b.column(at)], ["id", "text"])])
            yield b.append_column(flag, pa.array([p != NONE and s >= least for p, s in zip(found.column(1).to_pylist(), found.column(2).to_pylist())]))

    return docs.mapInArrow(tidy(keep), StructType([*docs.schema.fields, StructField(flag, BooleanType())])).filter(F.col(flag)).select(*names)


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred, score."""
    net = train(training_windows(docs))
    return predicted(docs, net).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
