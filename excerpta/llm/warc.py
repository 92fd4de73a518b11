"""Revisit resolution: each not-modified record takes the payload of the latest earlier full response.

Records are matched by canonical URL. The match is an as-of join made of windows that never hold more than
one range of the order: records are dealt by range of (canonical URL, time, record id), the latest full
response is carried along inside each range, and only each range's last response of a URL is carried to the
later ranges. A URL with a third of all records covers a third of the ranges; between ranges it has one row
for each. Payloads stay where they are; only ids, validators and headers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parallelism, table

#: Headers that a not-modified answer may not change: those that describe the stored body or one connection.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that do not name a resource.
TRACKING = ("ref", "sid", "sessionid", "phpsessid", "fbclid", "gclid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")


def canonical_url(url: Column) -> Column:
    """Host and port in lower case without scheme, ``www.`` or default port; path without a last slash; sorted query without tracking; no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "(?i)^[a-z][a-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www[.]", ""), ":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING))
    tail = F.array_join(F.array_sort(query), "&")
    return F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit in ``records``.

    ``records``: record_id, url, ts (bigint), kind ('response' or 'revisit'), full (boolean), etag,
    last_modified, headers (map of lower-case names). Other columns are ignored. Out: record_id,
    canonical_url, response_id, outcome, headers (merged map).

    Outcomes: ``resolved``; ``mismatch``: the latest earlier full response has other validators; ``unchecked``:
    the revisit has no validator that the response has too (it resolves, but nothing vouches for it);
    ``no_response``: none is earlier, or the URL is null. An entity tag decides where both have one (weak
    comparison), else the modification date. A response at the same time is not earlier; of responses at one
    time the greatest id counts. Null times come first. Repeated rows give repeated results.
    """
    light = records.select("record_id", canonical_url(F.col("url")).alias("u"), "ts", "kind", F.coalesce("full", F.lit(False)).alias("full"), "etag", "last_modified", "headers")
    # at one time revisits come before responses, so that a response is always earlier than what follows it
    order = [F.col("ts").asc_nulls_first(), F.when(F.col("kind") == "revisit", 0).otherwise(1), F.col("record_id")]
    dealt = cut(light.repartitionByRange(parallelism(records), F.col("u").asc_nulls_first(), *order).withColumn("block", F.spark_partition_id()))
    answer = F.when((F.col("kind") == "response") & F.col("full") & F.col("u").isNotNull(), F.struct("record_id", "etag", "last_modified", "headers"))
    inside = Window.partitionBy("u", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("a", answer).withColumn("r", F.last("a", ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    rank = F.struct(F.col("ts"), F.col("record_id"))
    ends = dealt.withColumn("a", answer).groupBy("u", "block").agg(F.max_by("a", F.when(F.col("a").isNotNull(), rank)).alias("a"))
    before = Window.partitionBy("u").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("c", F.last("a", ignorenulls=True).over(before)).filter("c is not null").select(F.col("u").alias("cu"), F.col("block").alias("cb"), "c")
    both = near.join(carried, (F.col("u") == F.col("cu")) & (F.col("block") == F.col("cb")), "left").withColumn("r", F.coalesce("r", "c"))
    tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    same = F.when(tags, _weak(F.col("etag")) == _weak(F.col("r.etag"))).when(dates, F.col("last_modified") == F.col("r.last_modified"))
    outcome = F.when(F.col("r").isNull(), "no_response").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    none = F.create_map().cast("map<string,string>")
    allowed = F.map_filter(F.coalesce("headers", none), lambda k, _: ~F.lower(k).isin(*NOT_MERGED))
    stored = F.map_filter(F.coalesce("r.headers", none), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    merged = F.when(outcome.isin("resolved", "unchecked"), F.map_concat(stored, allowed))
    return both.select("record_id", F.col("u").alias("canonical_url"), F.col("r.record_id").alias("response_id"), outcome.alias("outcome"), merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records for each page: its capture, and a later not-modified answer under another spelling of the URL.

    Every 13th capture is not full. Of the answers every fifth has another entity tag, every fifth a weak one,
    every fifth only a date, every fifth nothing.
    """
    p = F.col("page_id")
    tag = F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16)
    quoted = F.concat(F.lit('"'), tag, F.lit('"'))
    day = F.concat(F.lit("day "), (p % 28).cast("string"))
    response = pages.select(
        (p * 2).alias("record_id"), "url", (p * 10).alias("ts"), F.lit("response").alias("kind"), (p % 13 != 0).alias("full"), quoted.alias("etag"), day.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("date"), (p * 10).cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    other = F.when(p % 5 == 0, '"stale"').when(p % 5 == 1, F.concat(F.lit("W/"), quoted)).when(p % 5 == 4, quoted)
    revisit = pages.select(
        (p * 2 + 1).alias("record_id"), F.concat(F.col("url"), F.lit("#seen")).alias("url"), (p * 10 + 5).alias("ts"), F.lit("revisit").alias("kind"), F.lit(False).alias("full"), other.alias("etag"),
        F.when(p % 5 == 2, day).alias("last_modified"),
        F.create_map(F.lit("date"), (p * 10 + 5).cast("string"), F.lit("content-length"), F.lit("0"), F.lit("age"), F.lit("5")).alias("headers"),
    )
    return response.unionByName(revisit)


def op1(pages: DataFrame) -> DataFrame:
    """record_id, canonical_url, response_id, outcome, headers (``name=value`` sorted, comma-joined; null if not resolved) of every revisit."""
    out = resolve_revisits(records_of_pages(pages))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("")))))
    return out.withColumn("headers", F.when(F.col("headers").isNotNull(), F.array_join(pairs, ",")))


ORACLE_SQL = """
with canon as (
    select page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?@]*@)?', '') as rest from pages),
parts as (
    select page_id, html,
        regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '') as host,
        regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' and
            lower(regexp_extract(p, '^([^=]*)', 1)) not in ('ref', 'sid', 'sessionid', 'phpsessid', 'fbclid', 'gclid', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content'))), '&') as tail
    from canon),
p as (select page_id, '"' || sha256(coalesce(html, ''))[1:16] || '"' as etag, strlen(html) as size, host || path || case when tail <> '' then '?' || tail else '' end as u from parts),
r as (
    select v.page_id, v.u, v.etag as own, max_by(a.page_id, a.page_id) as rid, max_by(a.etag, a.page_id) as tag, max_by(a.size, a.page_id) as size
    from p v left join p a on a.u = v.u and a.page_id * 10 < v.page_id * 10 + 5 and a.page_id % 13 <> 0 group by all),
j as (
    select *, case page_id % 5 when 0 then '"stale"' when 1 then own when 4 then own end as etag, page_id % 28 as d, rid % 28 as rd from r),
o as (
    select *, case when rid is null then 'no_response' when etag is not null then case when etag = tag then 'resolved' else 'mismatch' end
        when page_id % 5 = 2 then case when d = rd then 'resolved' else 'mismatch' end else 'unchecked' end as outcome from j)
select page_id * 2 + 1 as record_id, u as canonical_url, rid * 2 as response_id, outcome,
    case when outcome in ('resolved', 'unchecked') then 'age=5,cache-control=max-age=60,content-length=' || size || ',content-type=text/html,date=' || (page_id * 10 + 5) end as headers
from o
"""


def query(spark, sf_dir: str) -> DataFrame:
    return op1(table(spark, sf_dir, "pages"))
