"""Tables of the detection rules: names, types, headers."""

import pytest
from pyspark.sql import functions as F

from excerpta.functions import detect, encryption, text, types
from excerpta.operators import containers, reader


def column(spark, values, kind, *exprs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", *[e(F.col("v")).alias(f"c{k}") for k, e in enumerate(exprs)])
    return [tuple(r)[1:] for r in rows.orderBy("i").collect()]


NAMES = [("docs/readme.txt", "docs/readme.txt"), ("a/b/c/file.go", "a/b/c/file.go"), ("./file.txt", "file.txt"), ("../etc/passwd", None), ("a/b/c/d/../../../../../escape", None), ("/etc/passwd", None), ("C:\\Windows\\System32", None), ("", None), (".", None), ("../malicious.txt", None)]


def test_member_names(spark):
    assert [r[0] for r in column(spark, [n for n, _ in NAMES], "string", text.member_name)] == [w for _, w in NAMES]
    assert [containers.safe_name(n) for n, _ in NAMES] == [w for _, w in NAMES]


def test_paths(spark):
    got = column(spark, ["test.txt", "root/test.txt", "", "te\0st.txt", "../x", None], "string", detect.valid_path)
    assert [r[0] for r in got] == [True, True, False, False, False, False]


@pytest.mark.parametrize("path,ext,mime", [("a.docx", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("TEST.PDF", "pdf", "application/pdf"), ("x.mp3", "mp3", "audio/mpeg"), ("x.mp4", "mp4", "video/mp4"), ("d.e/x.jpg", "jpg", "image/jpeg"), ("x.jpeg", "jpeg", "image/jpeg"), ("x.tar.gz", "tar.gz", "application/x-tar-gz"), ("x.tar.bz2", "tar.bz2", "application/x-tar-bz2"), ("x.unknown", "unknown", "application/octet-stream"), ("noext", "", "application/octet-stream"), ("d.e/noext", "", "application/octet-stream")])
def test_extension_and_mime(spark, path, ext, mime):
    assert column(spark, [path], "string", detect.extension, lambda c: types.mime_of(detect.extension(c))) == [(ext, mime)]
    assert reader.extension(path) == ext


def test_mime_back(spark):
    pairs = [("audio/mpeg", "mp3"), ("audio/wav", "wav"), ("audio/midi", "mid"), ("audio/ogg", "ogg"), ("audio/flac", "flac"), ("audio/aac", "aac"), ("video/mp4", "mp4"), ("video/3gpp", "3gp"), ("application/winhlp", "hlp"), ("application/x-mscompress-szdd", "mscompress"), ("application/x-unknown-format", ""), ("", "")]
    assert [r[0] for r in column(spark, [m for m, _ in pairs], "string", types.extension_of_mime)] == [e for _, e in pairs]


def test_cardinalities():
    assert (len(types.OFFICE), len(types.ARCHIVE), len(types.IMAGE), len(types.VIDEO), len(types.AUDIO)) == (26, 10, 36, 28, 65)
    assert len(types.supported()) == 226
    assert len(types.mime_map()) == 263 and len(set(types.mime_map().values())) == 221
    assert len(types.back_map()) == 57
    assert sorted(types.NO_MIME) == sorted(t for t in types.supported() if t not in types.mime_map())


def test_magic(spark):
    heads = [("D0CF11E0A1B11AE1", "doc"), ("504B0304", "zip"), ("377ABCAF271C", "7z"), ("25504446", "pdf"), ("526172211A070100", "rar"), ("00", "")]
    got = column(spark, [bytes.fromhex(h) for h, _ in heads], "binary", detect.sniffed)
    assert [r[0] for r in got] == [t for _, t in heads]


def test_flags(spark):
    got = column(spark, [bytes.fromhex(h) for h in ("504B030414000900", "504B030414000000")], "binary", encryption.zip_encrypted)
    assert [r[0] for r in got] == [True, False]
    got = column(spark, [bytes.fromhex(h) for h in ("85", "8C", "C4", "504B0304", "D0CF11E0", "25504446")], "binary", encryption.pgp_like)
    assert [r[0] for r in got] == [True, True, True, False, False, False]
    got = column(spark, [None, b"", b"\x85", b"\x85abc"], "binary", lambda c: encryption.encrypted(c, F.lit("pgp")))
    assert [r[0] for r in got] == [False, False, False, True]


def test_budget():
    b = containers.Budget()
    assert b.allows(1 << 20) and not b.allows((1 << 30) + 1)
    assert not containers.Budget(left=100).allows(200)
    many = containers.Budget(entries=containers.MOST_ENTRIES - 1)
    many.count()
    with pytest.raises(ValueError):
        many.count()


def test_page_ranges(spark):
    got = column(spark, ["1-3,last,2", "r2", "5-3,4", "11", "first", "x", "", None], "string", lambda c: text.page_range(c, F.lit(10)))
    assert [r[0] for r in got] == [[1, 2, 3, 10], [8], [3, 4, 5], None, [1], None, None, None]


def test_log_truncation(spark):
    got = column(spark, ["", "hello world", "a" * 4096, "a" * 4196], "string", text.truncate_log)
    assert [r[0] for r in got] == ["", "hello world", "a" * 4096, "a" * 4096 + "...[truncated]"]


def test_cache_key(spark):
    key = lambda size, ocr: spark.range(1).select(text.cache_key(F.lit("/tmp/a.txt"), F.lit(123), F.lit(size), F.lit(ocr), F.lit(b"x"))).first()[0]
    assert key(456, False) == key(456, False) and key(456, False).count(":") == 4
    assert len({key(456, False), key(457, False), key(456, True)}) == 3
