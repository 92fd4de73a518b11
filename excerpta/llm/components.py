"""Connected components of a link table by alternating large-star and small-star rounds.

Nothing is gathered on the driver but one count and one checksum a round. Each round is two aggregations
with map-side combine and two equi-joins, so a hub with very many links only lengthens the streamed side of
a join, which adaptive execution splits. A local union-find over each task's own links runs first and
shortens the chains; it holds a bounded number of links at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, tidy

#: Links that a task contracts together.
LOCAL_LINKS = 500_000
#: Rounds are logarithmic in the longest chain; this only stops a run that could never end.
MAX_ROUNDS = 60


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top and p != x:
            parent[x] = top
            x = p
        return top

    def flush() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["hi", "lo"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) >= LOCAL_LINKS:
            yield flush()
    yield flush()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("n"), F.col("lo").alias("o")).unionByName(e.select(F.col("lo").alias("n"), F.col("hi").alias("o")))
    least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.filter("o > n").join(least, "n").select(F.col("o").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: two bigint columns, in any order, loops and repeats allowed, nulls dropped.

    Returns ``node, root`` for every node that has a link to another node; ``root`` is the least node of its
    component. No links: no rows.
    """
    a, b = links.columns[:2]
    e = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.mapInArrow(tidy(_contract), "hi long, lo long").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = now
        last, e = e, cut(_small_star(_large_star(e)))
        dropped(last)
    raise RuntimeError("components did not settle")


def with_components(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``node, component`` of every row of ``nodes`` (``node``, all different, and ``least``): the least ``least`` of its component, by ``roots`` (``node, root``).

    The joins' sides are written tables, so that adaptive execution can split a component with a third of all nodes.
    """
    linked = cut(nodes.join(roots.select(F.col("node").alias(node), "root"), node).select(node, "root", "least"))
    of_root = cut(linked.groupBy("root").agg(F.min("least").alias("component")))
    named = linked.join(of_root, "root").select(node, "component")
    return cut(nodes.join(named, node, "left").select(node, F.coalesce("component", "least").alias("component")))
