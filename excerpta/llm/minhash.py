"""One-permutation MinHash with optimal densification and packed low-order bits, in Spark expressions only.

Each text's word shingles are hashed once. The top eight bits of a hash name its bin, the rest is its value;
each of the 256 bins keeps its least value. An empty bin copies a bin that is not empty, chosen by its own
sequence of hashed probes, so two texts with the same filled bins choose alike and each choice is uniform; the
copy is hashed with the bin's number, so that the low bits of many copies of one value stay independent.
Four low-order bits of every bin are kept, 16 bins to a bigint. Two unlike bins agree by chance in one of 16
cases; the share of equal bins is corrected for that.

A text without words has no fingerprint bits to compare: it is like any other such text (1.0) and unlike the
rest (0.0). ``fingerprint`` is 256 hex digits, one a bin, or an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, parallelism, text_or_empty

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 4
PER_LONG = 64 // LOW_BITS
#: Probes tried one by one; a bin that has met only empty ones takes the filled bin of least hash.
PROBES = 12
_VALUE = (1 << (64 - BIN_BITS)) - 1


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the lower-cased text's word shingles, repeats included; fewer words: of the whole sequence; none: empty."""
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")

    def of(h: Column) -> Column:
        n = F.size(h)
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        at = lambda i, k: F.get(h, i + k)
        all_of = F.transform(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))), lambda i: F.xxhash64(*[at(i, k) for k in range(shingle)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, whole).otherwise(all_of)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def bin_minima(hashes: Column) -> Column:
    """The least hash of each bin in bin order. One stand-in a bin, the bin's greatest hash, marks the empty ones."""
    stand_ins = F.transform(F.sequence(F.lit(-(BINS // 2)), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(_VALUE)))
    top = lambda x: F.shiftright(x, 64 - BIN_BITS)
    return let(F.sort_array(F.concat(hashes, stand_ins)), lambda s: F.filter(s, lambda x, i: (i == 0) | (top(x) != top(F.get(s, i - 1)))))


def densified(minima: Column) -> Column:
    """Values of all bins, the empty ones filled. At least one bin must be filled."""
    low = lambda x: x.bitwiseAND(F.lit(_VALUE))
    empty = lambda x: low(x) == F.lit(_VALUE)

    def fill(m: Column) -> Column:
        def probe(i: Column) -> Column:
            tries = F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda a: F.get(m, F.pmod(F.xxhash64(i, a), F.lit(BINS)).cast("int")))
            rest = F.array_min(F.transform(F.filter(m, lambda x: ~empty(x)), lambda x: F.struct(F.xxhash64(i, F.shiftright(x, 64 - BIN_BITS)).alias("h"), x.alias("x"))))["x"]
            return F.coalesce(F.get(F.filter(tries, lambda x: ~empty(x)), F.lit(0)), rest)

        return F.transform(m, lambda x, i: low(F.when(empty(x), F.xxhash64(probe(i), i)).otherwise(x)))

    return let(minima, fill)


def packed(values: Column) -> Column:
    """Low-order bits of the bins, packed into bigints."""

    def pack(v: Column) -> Column:
        one = lambda j: F.aggregate(
            F.slice(v, j * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
        )
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), one)

    return let(values, pack)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Packed fingerprint (array of bigint) of a text; empty where the text has no words."""
    return let(shingle_hashes(text, shingle), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(packed(densified(bin_minima(h)))))


def hex_digits(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, 0 to 1."""
    ones = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(ones))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, n: s + n)
    chance = 1.0 / (1 << LOW_BITS)
    share = 1.0 - unequal / F.lit(float(BINS))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1.0 - chance)))


MOST_BLOCKS = 1 << 16
_WIDE = 256


def with_next(df: DataFrame, key: str, tie: str, carried: list[str]) -> DataFrame:
    """Adds a ``next_`` twin of each carried column: that of the next row by descending key, after the last: of the first.

    Keys (bigint, not null) are cut into blocks near their quantiles, each block ending at the greatest key
    that it holds. The row after a block's last one is the first row of the block below, whose key is that
    block's end, so it is sent to both, and the very first row is sent to the lowest block too: every row
    moves once and no block is joined to another. Rows of one key stay in one block, ordered by ``tie``.
    """
    n = min(4 * parallelism(df), MOST_BLOCKS)
    numbers = lambda xs: F.from_json(F.lit(str(xs)), "array<array<bigint>>")

    def block_of(ends: list[int]) -> Column:
        if not ends:
            return F.lit(0)
        groups = [ends[i : i + _WIDE] for i in range(0, len(ends), _WIDE)]
        below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col(key)))
        group = below(F.get(numbers([[g[-1] for g in groups]]), F.lit(0)))
        return let(group, lambda g: F.when(g == len(groups), F.lit(len(ends))).otherwise(g * _WIDE + below(F.get(numbers(groups), g))))

    shares = [i / n for i in range(1, n)]
    near = df.agg(F.percentile_approx(key, shares, 20 * n)).first()[0] if shares else []
    ends = sorted(r[1] for r in df.groupBy(block_of(sorted({int(x) for x in near or []})).alias("b")).agg(F.max(key)).collect())
    if not ends:
        return df.withColumns({f"next_{c}": F.col(c) for c in carried})
    first = ends.pop()
    end = F.get(F.get(numbers([ends]), F.lit(0)), F.col("__block")) if ends else F.lit(None)
    send = F.filter(
        F.array(
            F.struct(F.col("__block").alias("block"), F.lit(0).alias("guest")),
            F.when(F.col(key) == end, F.struct((F.col("__block") + 1).alias("block"), F.lit(1).alias("guest"))),
            F.when(F.col(key) == first, F.struct(F.lit(0).alias("block"), F.lit(2).alias("guest"))),
        ),
        lambda x: x.isNotNull(),
    )
    sent = df.withColumn("__block", block_of(ends)).withColumn("__to", F.explode(send)).withColumn("__at", F.col("__to.block")).withColumn("__guest", F.col("__to.guest"))
    w = Window.partitionBy("__at").orderBy(F.col("__guest"), F.col(key).desc(), F.col(tie).asc_nulls_first())
    ahead = sent.select(*df.columns, "__at", "__guest").withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return ahead.filter("__guest = 0").drop("__at", "__guest")


def op2(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document. Null ids come after all others in the order; repeated ids go by text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    base = base.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("print", fingerprint(F.col("text")))
    ahead = with_next(base, "key", "text", ["text", "print"]).withColumn("n_chars", F.char_length("text").cast("long"))
    taken = F.floor(F.col("n_chars") / 3).cast("int")
    edited = ahead.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - taken).cast("int")), F.substring("next_text", F.lit(1), taken)))
    judged = edited.withColumn("of", let(fingerprint(F.col("edited")), lambda e: F.struct(hex_digits(e).alias("digits"), likeness(F.col("print"), e).alias("near"))))
    return judged.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hex_digits(F.col("print")).alias("fingerprint"),
        F.col("of.digits").alias("edited_fingerprint"),
        F.col("of.near").alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
