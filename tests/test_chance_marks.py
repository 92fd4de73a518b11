"""Bytes that look like a mark of encryption by chance are none."""

import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from excerpta.functions import encryption
from excerpta.operators import legacy
from excerpta.plans import catalog
from excerpta.plans import synthesise as S


@pytest.mark.parametrize("ext", ["bz2", "tar.bz2"])
def test_bzip2_stream_with_letters(spark, ext):
    rows = [(b"BZh91AY&SY\x01PGP\x02" + b"\0" * 90, ext), (b"BZh91AY&SY\x01PGP\x02", "txt"), (b"about PGP", ext)]
    got = spark.createDataFrame(rows, "c binary, ext string").select(encryption.encrypted(F.col("c"), F.col("ext"))).collect()
    assert [r[0] for r in got] == [False, True, True]


@pytest.mark.parametrize("name", ["xz_round_trip", "tar_xz_round_trip", "gz_round_trip", "tar_gz_round_trip", "bz2_round_trip", "tar_bz2_round_trip"])
def test_texts_with_the_letters(spark, tmp_path, name):
    """xz stores what it can't compress, so the letters of a short text are in the stream."""
    spark.sql("select id as doc_id, array('PGP', 'about PGP keys', 'other')[id] as text from range(3)").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    duckdb.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(catalog.oracle_sql()[name]).fetchall()) and len(got) == 3

@pytest.mark.parametrize("mode", ["reference", "fixed"])
def test_numbers_with_the_bytes_of_a_lock(mode):
    """8704.37 has the bytes 2F 00; so has the 48th row of any sheet."""
    assert b"\x2f\x00" in struct.pack("<d", 8704.37)
    assert not legacy.ole_encrypted(S.xls_numbers([""], [8704.37]), "xls", mode)
    assert not legacy.ole_encrypted(S.xls("\n" * 47 + "word"), "xls", mode)
    assert legacy.ole_encrypted(S.xls("word", locked=True), "xls", mode)


def test_xls_numbers_of_such_balances(spark, tmp_path):
    spark.sql("select id as c_custkey, array(8192.37D, 8704.37D, 9216.37D, 9728.37D)[id % 4] as c_acctbal from range(8)").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["c_custkey"]: r["content"] for r in catalog.queries()["xls_numbers"](spark, str(tmp_path)).collect()}
    duckdb.execute(f"create or replace view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert got == dict(duckdb.sql(catalog.oracle_sql()["xls_numbers"]).fetchall()) and len(got) == 8
