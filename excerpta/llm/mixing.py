"""Mixing sources to target weights by systematic sampling.

Sizes are word counts. A source's target is its share, by weight, of ``share`` times all words, capped at
``most_copies`` times its own words; the excess is shared again by weight until no source is above its cap.
Within a source every document is expected ``target / source_size`` times. The expected copies are summed along
an order, one random offset per source is added, and a document is taken once for each whole number that its
part of the sum crosses. Half of the documents, by a hash, come in ascending order of size and the others after
them in descending order: neighbours can stand for each other, and what an offset takes too much of in one half
it takes too little of in the other. A source of a few documents can still miss its target by the size of one;
there the offset is drawn again, a bounded number of times.

The order is global within a source, but no source is ever one task: rows are dealt by range of (source, half,
size, hash, id), so a source with a third of all rows covers a third of the ranges; a block is the part of a
source in one range, and only the blocks' counts are summed along a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType

from .common import WORD, cut, fresh, parallelism, text_or_empty

#: Weights that sources take in turn, by code point of their names.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
SEED = 20240601
#: Offsets drawn for a source at most, and the part of the target by which its words may miss it without another draw.
DRAWS, CLOSE = 16, 0.005


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES) -> DataFrame:
    """``source, source_size`` in; adds ``target``. A source name may be null; it comes last.

    The waterline is found by repeating the reshare: each round is one aggregate over the source table and at
    least one more source reaches its cap, usually many at once.
    """
    ordered = cut(sizes.select("source", "source_size").repartitionByRange(parallelism(sizes), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, starts = 0, []
    for part, n in sorted(map(tuple, ordered.groupBy("part").count().collect())):
        starts.append((part, before))
        before += n
    starts = F.broadcast(sizes.sparkSession.createDataFrame(starts, "p int, before long"))
    turn = (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    placed = ordered.join(starts, F.col("part") == F.col("p")).withColumn("turn", turn)
    weighed = cut(placed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), F.col("turn").cast("int") + 1).alias("w"), (F.lit(float(most_copies)) * F.col("source_size")).alias("cap")))
    total = share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    line, n_capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * F.lit(line)
        row = weighed.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if row[0] == n_capped or not row[2]:
            break
        n_capped, line = row[0], max(0.0, total - float(row[1] or 0)) / float(row[2])
    return weighed.select("source", "source_size", F.least("cap", F.col("w") * F.lit(line)).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, carried: tuple[str, ...] = (), **targets) -> DataFrame:
    """One row per input row: ``id, source, size, source_size, target, copies, taken`` and the ``carried`` columns.

    Null texts have size 0, a null source is a source of its own, rows with a null id are ordered first.
    Documents without words are taken like others but take no words. Identical rows stand next to each other
    in the order, so which of them is taken makes no difference. A run with the same rows gives the same
    result, however they are dealt. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_or_empty(text_col)).alias("size"), *carried)
    down = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.lit(2)) == 1
    order = [down, F.when(down, -F.col("size")).otherwise(F.col("size")), F.xxhash64(F.lit(seed), F.col("id")), F.col("id"), *carried]
    dealt = cut(sized.repartitionByRange(parallelism(docs), F.col("source").asc_nulls_last(), *order).withColumn("block", F.spark_partition_id()))
    blocks = cut(dealt.groupBy("source", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), **targets)
    named = target.withColumnRenamed("source", "s")
    plan = blocks.withColumn("before", before).join(named, F.col("source").eqNullSafe(F.col("s"))).select("source", "block", "before", "source_size", "target")
    plan = plan.select(F.col("source").alias("s"), F.col("block").alias("b"), "before", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "block").orderBy(*order))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ranked = dealt.withColumn("rank", rank).join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    ranked = cut(ranked.select("id", "source", "block", "size", "source_size", "target", *carried, rate.alias("rate"), (F.col("before") + F.col("rank")).alias("last")))
    copies = lambda offset: (F.floor(offset + F.col("last") * F.col("rate")) - F.floor(offset + (F.col("last") - 1) * F.col("rate"))).cast("long")
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.coalesce("source", F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    tried = ranked.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(F.col("size") * copies(draw(k))).alias(f"t{k}") for k in range(DRAWS)])
    drawn = [F.struct(F.when(F.abs(F.col(f"t{k}") - F.col("target")) <= CLOSE * F.col("target"), 0.0).otherwise(F.abs(F.col(f"t{k}") - F.col("target"))).alias("off"), F.lit(k).alias("k"), draw(k).alias("offset")) for k in range(DRAWS)]
    offsets = tried.select(F.col("source").alias("s"), F.array_min(F.array(*drawn))["offset"].alias("offset"))
    per_block = blocks.join(offsets, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("block").alias("b"), "offset")
    out = ranked.join(per_block, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("copies", copies(F.col("offset")))
    return out.select("id", "source", "size", "source_size", "target", *carried, "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _hashable(c: Column, kind: DataType) -> Column:
    return F.array_sort(F.map_entries(c)) if isinstance(kind, MapType) else c


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: the documents, all columns, each as often as it is taken.

    Rows are known by 128 bits over all their columns; those equal in all columns are one row that is taken as
    often as all of them. Documents move once, by that key, so no id or source gathers them in one task.
    """
    one, two, n = fresh("one"), fresh("two"), fresh("n")
    cells = [_hashable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields]
    keyed = docs.withColumns({one: F.xxhash64(*cells), two: F.xxhash64(F.lit(SEED), *cells)})
    taken = mixed(keyed, id_col, text_col, source_col, carried=(one, two), **kw).groupBy(one, two).agg(F.sum("copies").alias(n)).filter(F.col(n) > 0)
    out = keyed.dropDuplicates([one, two]).join(taken, [one, two])
    return out.withColumn(fresh("copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[f"`{c}`" for c in docs.columns])


def op4(docs: DataFrame) -> DataFrame:
    return mixed(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")
