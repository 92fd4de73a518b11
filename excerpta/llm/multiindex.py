"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves, each with its own codebook; a vector lies in the cell of the product grid
that its halves' nearest centroids name. Every vector visits the cells nearest to it in order of the summed
distances (a cell at places a and b of the two orders can be among the first T only if (a + 1)(b + 1) <= T,
so only those are compared), and each candidate in them is verified in double precision. T is the number of
cells that reaches the target recall on true links: a bounded sample of the vectors is held against all rows,
and for each link the number of visits that finds it is noted. T is never less than what the sampled vectors
need for partners at exactly the threshold's angle in random directions. A link counts for both vectors if
either visits the other's cell.

Equal vectors are one vector with a weight. Neighbouring cells of a first-half centroid share a shelf of bounded
size, and a cell that is larger has a shelf of its own, dealt into blocks. Queries come once to each block of a
shelf for all the cells that they visit there, in streams; a task keeps one block and one batch. So a query is
sent to as many places as it visits cells at most, whatever the number of vectors, and to the blocks of very
large cells. A task returns sums and a spanning forest of what it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, parallelism, tidy
from .components import connected_components, with_components

THRESHOLD = 0.9
#: Bounds of the fitting sample, and of the vectors that measure recall.
SAMPLE, MEASURED = 8192, 1024
PER_CELL = 128
MOST_CENTROIDS = 1024
TARGET_RECALL = 0.97
#: Partners of a sampled vector that are looked at in a batch; the others count by weight.
PARTNERS = 16
BLOCK = 4096
BATCH = 1024
SEED = 11


@dataclass
class Index:
    """Two codebooks and the number of cells that a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return _square_distances(x[:, :h], self.first), _square_distances(x[:, h:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cells that each vector visits, nearest first; the first one is its own."""
        d1, d2 = self.distances(x)
        o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        a, b = (v.ravel() for v in np.indices((d1.shape[1], d2.shape[1])))
        may = (a + 1) * (b + 1) <= self.visits
        a, b = a[may], b[may]
        near = np.argsort(s1[:, a] + s2[:, b], axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(o1, a[near], 1) * len(self.second) + np.take_along_axis(o2, b[near], 1)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Each vector's own cell."""
        a, b = (d.argmin(axis=1) for d in self.distances(x))
        return a * len(self.second) + b

    def places(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells each vector visits until it comes to the given one."""
        out, k = np.zeros(len(x), np.int64), len(self.second)
        for i in range(0, len(x), 1024):
            d1, d2 = self.distances(x[i : i + 1024])
            rows, c = np.arange(len(d1)), cells[i : i + 1024]
            goal = d1[rows, c // k] + d2[rows, c % k] + 1e-12
            if k <= 64:
                out[i : i + 1024] = (d1[:, :, None] + d2[:, None, :] <= goal[:, None, None]).sum(axis=(1, 2))
            else:
                d2.sort(axis=1)
                out[i : i + 1024] = [np.searchsorted(d2[r], goal[r] - d1[r], side="right").sum() for r in rows]
        return out


def _square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _square_distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, n_vectors: int, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> Index:
    """An index for ``n_vectors`` rows fitted to a bounded sample of unit vectors."""
    rng = np.random.default_rng(SEED)
    half = sample.shape[1] // 2
    k = int(min(max(1, np.ceil((n_vectors / PER_CELL) ** 0.5)), MOST_CENTROIDS, max(1, len(sample) // 8)))
    index = Index(_k_means(sample[:, :half], k, rng), _k_means(sample[:, half:], k, rng), k * k)
    x = sample[rng.choice(len(sample), min(len(sample), MEASURED), replace=False)]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    y = threshold * x + (1 - threshold**2) ** 0.5 * side / np.where(norm > 0, norm, 1)
    place = index.places(x, index.homes(y))
    index.visits = int(min(k * k, max(1, np.quantile(place, recall, method="higher"))))
    return index


def _needs(index: Index, ids: np.ndarray, q: np.ndarray, weights: np.ndarray, threshold: float):
    """For links of the sampled vectors ``q`` with all rows ``id, v, n``: how many visits find them, as ``query, need, links``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_home = index.homes(q)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                x, n = _units(part.column(1)), part.column(2).to_numpy()
                hit = (x @ q.T >= threshold) & (part.column(0).to_numpy()[:, None] != ids[None])
                nth = np.cumsum(hit, axis=0)
                p, r = np.nonzero(hit & (nth <= PARTNERS))
                need = np.minimum(index.places(q[r], index.homes(x)[p]), index.places(x[p], at_home[r]))
                share = nth[-1, r] / np.minimum(nth[-1, r], PARTNERS)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(need), pa.array(share * n[p] * weights[r])], ["query", "need", "links"])

    return run


def visits_for(index: Index, groups: DataFrame, sample: list, threshold: float, recall: float = TARGET_RECALL) -> tuple[int, float, float]:
    """Visits that reach the recall on the links of sampled rows ``id, v, n`` with all of ``groups``, over all links and on the mean of the vectors; with both recalls measured at them."""
    q = _unit_rows(np.array([r["v"] for r in sample], np.float64))
    needs = groups.select("id", "v", "n").repartition(parallelism(groups)).mapInArrow(tidy(_needs(index, np.array([r["id"] for r in sample]), q, np.array([r["n"] for r in sample], np.float64), threshold)), "query int, need long, links double")
    needs = cut(needs.groupBy("query", "need").agg(F.sum("links").alias("links")))
    total = needs.groupBy("query").agg(F.sum("links").alias("total"))
    rows = sorted(needs.join(total, "query").groupBy("need").agg(F.sum("links"), F.sum(F.col("links") / F.col("total"))).collect())
    if not rows:
        return index.visits, 1.0, 1.0
    need, *shares = (np.array(c, np.float64) for c in zip(*rows))
    shares = [np.cumsum(c) / c.sum() for c in shares]
    reach = [int(need[min(np.searchsorted(c, recall), len(c) - 1)]) for c in shares]
    visits = max(index.visits, *reach)
    met = np.flatnonzero(need <= visits)
    return visits, *(float(c[met[-1]]) if len(met) else 0.0 for c in shares)


def usable(v: Column) -> Column:
    """Whether a vector can link: not null, all components finite, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit_rows(flat.reshape(len(column), -1))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _homes(index: Index):
    """Each vector's own cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [index.homes(_units(b.column(0).slice(at, BATCH))) for at in range(0, b.num_rows, BATCH)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *near]).astype(np.int32))], ["cell"])

    return run


def shelves(counts: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The shelf of each cell, and the number of blocks of each shelf. ``counts``: members by cell, ``k`` cells a first-half centroid."""
    of, blocks = np.zeros(len(counts), np.int32), []
    held = 0
    for cell, n in enumerate(counts.tolist()):
        if cell % k == 0 or held + n > block:
            blocks.append(1)
            held = 0
        of[cell] = len(blocks) - 1
        held += n
        blocks[-1] = max(1, -(-held // block))
    return of, np.array(blocks, np.int64)


def _deal(index: Index, shelf_of: np.ndarray, blocks: np.ndarray):
    """Members to a block of their own cell's shelf with all cells that they visit, queries to all blocks of each shelf with their own cell and those that they visit there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "query", "id", "v", "n", "cells"]
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                cells = index.cells(_units(part.column(1)))
                own = cells[:, 0]
                # the stable order keeps nearer cells first; the own cell is known by its number
                order = np.argsort(shelf_of[cells], axis=1, kind="stable")
                by_shelf = np.take_along_axis(cells, order, 1)
                to = shelf_of[by_shelf]
                starts = np.flatnonzero(np.concatenate((np.ones((len(to), 1), bool), to[:, 1:] != to[:, :-1]), axis=1))
                row = starts // cells.shape[1]
                sizes = np.diff(np.append(starts, cells.size))
                values = np.insert(by_shelf.ravel(), starts, own[row])
                visited = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes + 1))).astype(np.int32), pa.array(values.astype(np.int32)))
                whole = pa.ListArray.from_arrays(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1], pa.array(cells.ravel().astype(np.int32)))
                shelf = to.ravel()[starts]
                again = np.repeat(np.arange(len(starts)), blocks[shelf])
                nth = np.arange(len(again)) - np.repeat(np.cumsum(blocks[shelf]) - blocks[shelf], blocks[shelf])
                mixed = (part.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for query, r, p, block, lists in (
                    (0, np.arange(len(cells)), shelf_of[own], mixed.astype(np.int64) % blocks[shelf_of[own]], whole),
                    (1, row[again], shelf[again], nth, visited.take(pa.array(again))),
                ):
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(r), query, np.int32)), part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), lists], names)

    return run


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) links of a spanning forest of a bipartite table of links."""
    rows, cols = [], []
    new_rows = hit.any(axis=1)
    open_cols = hit.any(axis=0)
    while new_rows.any():
        front = np.array([int(new_rows.argmax())])
        new_rows[front] = False
        while len(front):
            reach = np.flatnonzero(hit[front].any(axis=0) & open_cols)
            open_cols[reach] = False
            rows.append(front[hit[np.ix_(front, reach)].argmax(axis=0)] if len(reach) else reach)
            cols.append(reach)
            if not len(reach):
                break
            front = np.flatnonzero(hit[:, reach].any(axis=1) & new_rows)
            new_rows[front] = False
            if len(front):
                cols.append(reach[hit[np.ix_(front, reach)].argmax(axis=1)])
                rows.append(front)
    return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *cols])


def _search(threshold: float):
    """Rows sorted by (part, block, query): a block's members, then its queries in streams. Out: (id, links, other): sums where other is null, else a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, members = None, [], None

        def close() -> None:
            nonlocal members
            t = pa.Table.from_batches(kept).combine_chunks()
            x, own = _units(t.column("v").combine_chunks()), _cells(t.column("cells").combine_chunks())
            order = np.argsort(own[:, 0], kind="stable")
            second = own[order, 0]
            starts = np.flatnonzero(np.concatenate(([True], second[1:] != second[:-1])))
            members = (x[order], own[order], t.column("id").to_numpy()[order], t.column("n").to_numpy()[order], second[starts], np.append(starts, len(order)))

        def compare(part: pa.RecordBatch) -> pa.RecordBatch:
            x, own, ids, weights, cells, bounds = members
            q, visits, qid, qn = _units(part.column("v")), _cells(part.column("cells")), part.column("id").to_numpy(), part.column("n").to_numpy()
            sums: list[tuple[np.ndarray, np.ndarray]] = []
            links: list[tuple[np.ndarray, np.ndarray]] = []
            for c, a, b in zip(cells, bounds[:-1], bounds[1:]):
                rows = np.flatnonzero((visits[:, 1:] == c).any(axis=1))
                if not len(rows):
                    continue
                hit = q[rows] @ x[a:b].T >= threshold
                hit &= qid[rows][:, None] != ids[a:b][None]
                if not hit.any():
                    continue
                some = hit.any(axis=1)
                rows, hit = rows[some], hit[some]
                sums.append((qid[rows], hit @ weights[a:b]))
                # the other side counts the link itself if it visits this query's cell
                for i in range(0, len(rows), 64):
                    r, m = np.nonzero(hit[i : i + 64])
                    back = ~(own[a + m] == visits[rows[i + r], 0][:, None]).any(axis=1)
                    if back.any():
                        total = np.bincount(m[back], qn[rows[i + r[back]]], b - a).astype(np.int64)
                        to = np.flatnonzero(total)
                        sums.append((ids[a + to], total[to]))
                r, m = _forest(hit)
                links.append((qid[rows[r]], ids[a + m]))
            cat = lambda xs, j: np.concatenate([np.zeros(0, np.int64), *[x[j] for x in xs]]).astype(np.int64)
            n, m = cat(sums, 0), cat(links, 0)
            other = pa.array(np.concatenate((np.zeros(len(n), np.int64), cat(links, 1))), mask=np.arange(len(n) + len(m)) < len(n))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((n, m))), pa.array(np.concatenate((cat(sums, 1), np.zeros(len(m), np.int64)))), other], ["id", "links", "other"])

        for batch in batches:
            parts, blocks, query = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((parts[1:] != parts[:-1]) | (blocks[1:] != blocks[:-1]) | (query[1:] != query[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)]):
                if a == b:
                    continue
                if (parts[a], blocks[a]) != key:
                    key, kept, members = (parts[a], blocks[a]), [], None
                if not query[a]:
                    kept.append(batch.slice(a, b - a))
                    continue
                if not kept:
                    continue
                if members is None:
                    close()
                for i in range(a, b, BATCH):
                    yield compare(batch.slice(i, min(BATCH, b - i)))

    return run


def _cells(column: pa.Array) -> np.ndarray:
    """Lists of cells as rows, filled up with -1."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(sizes), sizes.max(initial=0)), -1)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def linked_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id, n_links, component``.

    Cosines are computed in double precision; vectors of other than floats are taken as doubles. Vectors that are null, zero or hold null or non-finite components link with nothing. Only vectors of one
    length are compared, each length by an index of its own. Equal vectors always link; rows that repeat an id
    count as further vectors. Rows with a null id have no component but count as links of others.
    """
    kind = rows.schema[vector_col].dataType
    vector = F.col(vector_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector_col).cast("array<double>")
    base = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    base = base.withColumn("ok", usable(F.col("v")))
    out = base.filter(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    for (d,) in base.filter("ok").select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        good = base.filter(F.col("ok") & (F.size("v") == d)).select("id", "v")
        out = out.unionByName(_linked_signs(good) if d == 1 else _linked_of_length(good, threshold))
    return out


def _linked_signs(good: DataFrame) -> DataFrame:
    """Vectors of length 1: the cosine is the product of the signs."""
    sign = F.signum(F.get("v", F.lit(0)).cast("double"))
    of = good.groupBy(sign.alias("sign")).agg(F.min("id").alias("component"), (F.count("*") - 1).alias("n_links"))
    return good.join(F.broadcast(of), sign == F.col("sign")).select("id", "n_links", "component")


def _linked_of_length(good: DataFrame, threshold: float) -> DataFrame:
    groups = cut(good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    n = groups.count()
    drawn = groups.orderBy(F.xxhash64(F.lit(SEED), "v")).select("id", "v", "n").limit(SAMPLE).collect()
    sample = _unit_rows(np.array([r["v"] for r in drawn], np.float64))
    index = fit(sample, n, threshold)
    index.visits, *_ = visits_for(index, groups, drawn[:MEASURED], threshold)
    spread = groups.select("id", "v", "n").repartition(parallelism(good))
    # a count for each cell, at most MOST_CENTROIDS squared
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for cell, members in groups.select("v").mapInArrow(tidy(_homes(index)), "cell int").groupBy("cell").count().collect():
        counts[cell] = members
    shelf_of, blocks = shelves(counts, len(index.second))
    dealt = spread.mapInArrow(tidy(_deal(index, shelf_of, blocks)), f"part int, block int, query int, id long, v {groups.schema['v'].dataType.simpleString()}, n long, cells array<int>")
    laid = dealt.repartition(parallelism(good), "part", "block").sortWithinPartitions("part", "block", "query")
    found = cut(laid.mapInArrow(tidy(_search(threshold)), "id long, links long, other long"))
    sums = found.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("other is not null").select("id", "other"))
    named = with_components(cut(groups.select("id", "least")), roots, "id")
    of = cut(groups.join(sums, "id", "left").join(named, "id").select(F.col("v").alias("gv"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"))
    return good.join(of, F.col("v") == F.col("gv")).select("id", "n_links", "component")


def op7(rows: DataFrame) -> DataFrame:
    """The contract's columns: vec_id, n_links, component_id, kept."""
    out = linked_vectors(rows)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


ORACLE_SQL = """
with recursive v as (
    select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least on least.a = e.vec_id left join n on n.a = e.vec_id
"""
