"""Workbooks of many small rows: filling costs nothing, and all cores get rows."""

import random
import struct

import duckdb

from excerpta.operators import legacy
from excerpta.plans import catalog
from excerpta.plans import synthesise as S


def plain_records(data):
    at, out = 0, []
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        out.append((kind, data[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def test_filling_is_one_record():
    stream = legacy.CompoundFile(S.xls_numbers(["0"], [1.5])).stream("Workbook")
    assert len(stream) == 4096 and len(list(legacy._biff(stream))) < 10


def test_records_around_zeros():
    deal = random.Random(7)
    for _ in range(2000):
        data = b"".join(deal.choice((b"\0" * deal.randrange(14), bytes(deal.randrange(3) for _ in range(5)))) for _ in range(20))
        plain = plain_records(data)
        assert list(legacy._biff(data)) == [r for i, r in enumerate(plain) if not (i and r == plain[i - 1] == (0, b""))]


def test_one_file_of_customers_goes_to_all_cores(spark, tmp_path):
    spark.sql("select id as c_custkey, (id * 37 - 500) / 8 as c_acctbal from range(64)").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = catalog.queries()["xls_numbers"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    duckdb.execute(f"create or replace view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = {r["c_custkey"]: r["content"] for r in df.collect()}
    assert got == dict(duckdb.sql(catalog.oracle_sql()["xls_numbers"]).fetchall()) and len(got) == 64
