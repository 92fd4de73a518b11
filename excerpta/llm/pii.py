"""Personal data: base patterns with checks, and more of it by bootstrapped contexts. Spark expressions only.

Base entities are the matches of four patterns that pass their checks (parts of an address at most 255, Luhn,
number of digits). They are the seeds. A fifth kind, secrets, has seeds but no base spans: long runs of letters
and digits, which count only where a context vouches for them. Every place that looks like an identifier, seeds included, has lexical
patterns around it: its two words to the left, and the word on either side. Patterns and the values seen in
them make a graph. Seeds have score 1 in their kind; a pattern's score in a kind is the smoothed mean of its
values' scores, and a value's score is the chance that at least one of its trusted patterns is right. Both
are repeated a few times over the whole corpus, and values of high score count as seeds in the next round, so
that they induce patterns of their own; then values of high score in patterns of high score, with
enough different seeds, are spans of that kind too. Base spans always stay.

A match's place is the sum of what comes before it: ``split`` gives the gaps, ``regexp_extract_all`` the
matches. The patterns are written so that no start is tried twice: possessive runs that may only start where
a run starts, or where the last match ended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method finds, in the order of spans.
FOUND_KINDS = (*KINDS, "secret")
#: Base patterns of the contract, in a linear form.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PATTERNS = (EMAIL, IP, CARD, PHONE)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What may be an identifier: a phone or card shape, or a run without blanks that has a digit or an at sign, written out or not.
_AT = r"[\[({](?i:at)[\])}]"
CANDIDATE = rf"{PHONE}|{CARD}(?=[^0-9A-Za-z@]|$)|(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+|(?<![^\s])[^\s]*?{_AT}[^\s]*+"
#: What can be a seed of a secret: at least 16 signs, letters and digits among them.
SECRET = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{16,}$"
ROUNDS = 3
#: Smoothing of a pattern's mean, seeds a pattern needs, scores that patterns and values need.
SMOOTH, LEAST_SEEDS, LEAST_SCORE = 0.5, 5, 0.8
#: Size up to which the documents with found spans are sent to every executor.
BROADCAST_BYTES = 8_000_000
_GROUP = 64


def running(sizes: Column) -> Column:
    """Sums of the numbers before each one. In groups, so that a text with very many matches stays cheap."""
    within = lambda g: F.aggregate(g, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def join(groups: Column) -> Column:
        base = within(F.transform(groups, lambda g: F.element_at(g, -1)))
        return let(base, lambda b: F.flatten(F.transform(groups, lambda g, i: F.transform(F.slice(g, 1, F.size(g) - 1), lambda x: x + F.get(b, i)))))

    def all_of(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _GROUP).cast("int")), lambda g: within(F.slice(s, g * _GROUP + 1, F.lit(_GROUP))))
        return F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(let(parts, join))

    return let(sizes, all_of)


def matches(text: Column, pattern: str) -> Column:
    """``value, start, before, after`` of all matches, left to right, in code points; the gaps on both sides come with them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            start = running(F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: F.char_length(a) + F.char_length(b)))
            return let(start, lambda s: F.transform(m, lambda v, i: F.struct(v.alias("value"), (F.get(s, i) + F.char_length(F.get(g, i))).alias("start"), F.get(g, i).alias("before"), F.get(g, i + 1).alias("after"))))

        return F.when(F.size(m) == 0, F.array().cast("array<struct<value:string,start:int,before:string,after:string>>")).otherwise(let(gaps, with_gaps))

    return let(found, place)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.char_length(digits) - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.char_length(digits).between(13, 19) & F.when(F.char_length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """``start, end`` of the matches of a kind that pass."""
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+")}[kind]
    kept = F.filter(matches(text, PATTERNS[KINDS.index(kind)]), lambda m: passes(kind, m["value"]))
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.char_length(m["value"])).alias("end")))
    return F.when(may, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _kind_of(value: Column) -> Column:
    """The first kind of seed that a candidate holds, or null."""
    holds = lambda k, p: F.exists(F.regexp_extract_all(value, F.lit(p), F.lit(0)), lambda v: passes(k, v))
    return reduce(lambda c, kp: c.when(holds(*kp), F.lit(kp[0])), list(zip(KINDS, PATTERNS))[1:], F.when(holds(KINDS[0], EMAIL), F.lit(KINDS[0]))).when(value.rlike(SECRET), "secret")


def candidates(text: Column) -> Column:
    """``value, start, end, kind, patterns`` of every place that looks like an identifier."""

    def of(m: Column) -> Column:
        core = F.regexp_extract(m["value"], r"(?s)[0-9A-Za-z@+(](?:.*[0-9A-Za-z])?", 0)

        def with_core(v: Column) -> Column:
            start = m["start"] + F.char_length(F.regexp_extract(m["value"], r"^[^0-9A-Za-z@+(]*", 0))
            left, right = F.lower(F.regexp_extract(m["before"], r"(\S*)\s+(\S*)\s*$", 1)), F.lower(F.regexp_extract(m["before"], r"(\S*)\s*$", 1))
            after = F.lower(F.regexp_extract(m["after"], r"^\S*\s+(\S+)", 1))
            ctx = F.array(F.concat(F.lit("l "), left, F.lit(" "), right), F.concat(F.lit("b "), right, F.lit(" _ "), after))
            return F.struct(F.lower(v).alias("value"), start.alias("start"), (start + F.char_length(v)).alias("end"), _kind_of(v).alias("kind"), F.when((left != "") | (right != ""), ctx).otherwise(F.array().cast("array<string>")).alias("patterns"))

        return let(core, with_core)

    near = F.transform(matches(text, CANDIDATE), lambda m: F.struct(m["value"].alias("value"), m["start"].alias("start"), F.right(m["before"], F.lit(80)).alias("before"), F.left(m["after"], F.lit(80)).alias("after")))
    like = lambda c: c["value"].rlike(rf"[0-9]|[0-9A-Za-z].*@|@.*[0-9A-Za-z]|{_AT}")
    return F.when(text.rlike(rf"[0-9@]|{_AT}"), F.filter(F.transform(near, of), like)).otherwise(F.array().cast("array<struct<value:string,start:int,end:int,kind:string,patterns:array<string>>>"))


def trusted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of the graph ``pattern, value, kind`` (null: not a seed): (pattern, kind) and (value, kind) that are trusted.

    Every step is an aggregation with partial sums or an equi-join; no pattern's values are ever gathered.
    """
    links = cut(edges.groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    of_pattern = links.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = cut(links.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")))
    unknown = cut(links.filter("seed is null").select("pattern", "value"))
    scores = None
    for _ in range(ROUNDS):
        if scores is None:
            base = seeds.withColumns({"more": F.lit(0.0), "taught": F.lit(0)})
        else:
            more = unknown.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("more"), F.count_if(F.col("score") >= LEAST_SCORE).alias("taught"))
            base = seeds.join(more, ["pattern", "kind"], "full").na.fill(0)
        patterns = base.filter(F.col("seeds") + F.col("taught") >= LEAST_SEEDS).join(of_pattern, "pattern").withColumn("score", (F.col("seeds") + F.col("more")) / (F.col("n") + SMOOTH))
        kept = cut(patterns.filter(F.col("score") >= LEAST_SCORE).select("pattern", "kind", "score"))
        miss = F.sum(F.log(F.greatest(1.0 - F.col("score"), F.lit(1e-9))))
        scores = cut(unknown.join(kept, "pattern").groupBy("value", "kind").agg((1.0 - F.exp(miss)).alias("score")))
    return kept.select("pattern", "kind"), scores.filter(F.col("score") >= LEAST_SCORE).select("value", "kind")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id``, the base spans of each kind and the candidates of every row, written once."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    return cut(rows.select("id", *[base_spans(F.col("t"), k).alias(k) for k in KINDS], candidates(F.col("t")).alias("c")).withColumn("row", F.monotonically_increasing_id()))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, arrays ``base`` and ``found`` of (k, start, end), k the kind's place in ``FOUND_KINDS``.

    Null texts are empty and have no spans. Repeated rows each keep their row. Found spans never overlap base
    ones. An empty table gives no rows.
    """
    base = scanned(docs, id_col, text_col)
    each = base.select("row", F.explode("c").alias("c")).select("row", "c.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "value", "kind")
    patterns, values = trusted(edges)
    named = each.select("row", "value", "start", "end", "kind", F.explode("patterns").alias("pattern"))
    hits = named.filter("kind is null").drop("kind").join(patterns, "pattern").join(values, ["value", "kind"])
    own = named.filter("kind = 'secret'").join(patterns, ["pattern", "kind"])
    hits = hits.select("row", "kind", "start", "end").unionByName(own.select("row", "kind", "start", "end"))
    number = F.array_position(F.array(*map(F.lit, FOUND_KINDS)), F.col("kind")).cast("int") - 1
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(number.alias("k"), "start", "end"))).alias("found"))
    none = F.array().cast("array<struct<k:int,start:int,end:int>>")
    of_kind = lambda i: lambda s: F.struct(F.lit(i).alias("k"), s["start"].alias("start"), s["end"].alias("end"))
    all_base = F.concat(*[F.transform(F.col(k), of_kind(i)) for i, k in enumerate(KINDS)])
    out = base.join(found, "row", "left").select("row", "id", all_base.alias("base"), F.coalesce("found", none).alias("found"))
    free = F.filter("found", lambda f: ~F.exists("base", lambda b: (f["start"] < b["end"]) & (b["start"] < f["end"])))
    return out.select("row", "id", "base", free.alias("found"))


def joined(spans_: Column) -> Column:
    names = F.array(*map(F.lit, FOUND_KINDS))
    return F.array_join(F.transform(F.array_sort(spans_), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _mask_kind(text: Column, kind: str) -> Column:
    pattern = PATTERNS[KINDS.index(kind)]
    put = lambda v: F.when(passes(kind, v), F.lit(f"<{kind}>")).otherwise(v)

    def rebuild(m: Column) -> Column:
        parts = F.zip_with(F.split(text, pattern, -1), F.transform(m, put), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        return F.when(F.size(m) == 0, text).otherwise(F.array_join(parts, ""))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rebuild)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The documents, all columns, personal data in their text replaced by its kind in angle brackets; ``n_chars`` follows.

    Found spans are put in first, from the right, then the base kinds one after the other, phone numbers
    before the cards that they may hold. A null text stays null. Found spans are matched by id and text.
    """
    key = lambda t: F.xxhash64(t)
    tagged = docs.withColumns({"__id": F.col(id_col).cast("long"), "__key": key(F.col(text_col))})
    rows = tagged.select("__id", "__key", F.col(text_col).cast("string").alias("__t"))
    named = F.struct(F.col("__id"), F.col("__key"))
    found = spans(rows.select(named.alias("who"), F.col("__t")), "who", "__t").filter(F.size("found") > 0)
    found = cut(found.select(F.col("id.__id").alias("__fid"), F.col("id.__key").alias("__fkey"), F.col("found").alias("__found")).dropDuplicates(["__fid", "__fkey"]))
    n = found.agg(F.sum(16 + 16 * F.size("__found"))).first()[0] or 0
    if n <= BROADCAST_BYTES:  # else the join moves the texts
        found = F.broadcast(found)
    out = tagged.join(found, F.col("__id").eqNullSafe(F.col("__fid")) & (F.col("__key") == F.col("__fkey")), "left")
    names = F.array(*map(F.lit, FOUND_KINDS))
    from_right = F.reverse(F.array_sort(F.transform("__found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k")))))
    place = lambda t, s: F.overlay(t, F.concat(F.lit("<"), F.get(names, s["k"]), F.lit(">")), s["start"] + 1, s["end"] - s["start"])
    text = F.when(F.col("__found").isNull(), F.col(text_col).cast("string")).otherwise(F.aggregate(from_right, F.col(text_col).cast("string"), place))
    out = out.withColumn("__text", text)
    for kind in ("email", "phone", "card", "ip"):
        out = out.withColumn("__text", _mask_kind(F.col("__text"), kind))
    new = {text_col: F.col("__text"), n_chars_col: F.coalesce(F.char_length("__text").cast("long"), docs[n_chars_col]) if n_chars_col in docs.columns else None}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col(c) for c in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, counts and digest of the base spans, all spans; and n_found."""
    out = spans(docs)
    count = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    return out.select(
        F.col("id").cast("long").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
