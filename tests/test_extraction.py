"""Whole files through the engine: every outcome, damaged inputs, nesting, streaming, the cache."""

import io
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from excerpta.functions import text as T
from excerpta.operators import containers, legacy, media, model, office, pdf, reader
from excerpta.plans import extract as X
from excerpta.plans import synthesise as S
from excerpta.sources import files as sources
from excerpta.streaming import ingest

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(p, None, len(c or b""), c) for p, c in rows], SCHEMA)
    return {r["file_name"]: r for r in X.extract(df, **kw).collect()}


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in entries:
            z.writestr(n, d)
    return out.getvalue()


def test_outcomes(spark):
    got = run(spark, [("a.txt", b"plain"), ("g.txt", "中文".encode("gbk")), ("m.mp3", b"abcd"), ("k.apk", b"abcd"), ("z.zzz", b"abcd"), ("p.txt", b"\x85abc"), ("v.vsd", b"abcd"), ("n.txt", None), ("../x.txt", b"a"), ("bad.zip", b"PK\x03\x04 broken"), ("bad.docx", b"nothing"), ("i.png", b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 7, 9)), ("j.png", b"abcd"), ("l.pgp", b"-----BEGIN PGP X\nabc\n-----END PGP X")])
    status = {k: (r["status"], r["content"]) for k, r in got.items()}
    assert status["a.txt"] == ("success", "plain") and status["g.txt"] == ("success", "中文") and status["n.txt"] == ("success", "")
    assert status["m.mp3"] == ("skipped", "") and got["m.mp3"]["skipped"] is True and got["k.apk"]["skipped"] is None
    assert status["k.apk"][0] == "skipped" and status["k.apk"][1].startswith("[file metadata]\nname: k.apk\nsize: 4 bytes\n")
    assert status["z.zzz"][0] == "failed" and got["z.zzz"]["error_msg"] == X.UNSUPPORTED
    assert status["p.txt"][0] == "failed" and got["p.txt"]["is_encrypt"] == 1
    assert status["v.vsd"][0] == "skipped" and status["x.txt"][0] == "failed"
    assert status["bad.zip"][0] == "failed" and status["bad.docx"][0] == "failed"
    assert status["i.png"] == ("success", "[image: no OCR enabled, png, 7x9]") and status["j.png"][1] == "[image: no OCR enabled, dimensions unavailable]"
    assert got["l.pgp"]["is_encrypt"] == 1 and status["l.pgp"] == ("failed", "")


def test_empty_table(spark):
    assert X.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archive_rules():
    slip = zipped([("../escape.txt", b"pwned"), ("hello.txt", b"Hello World"), ("sub/foo.txt", b"nested content")])
    assert [r[0] for r in reader.archive_rows("zip", "a.zip", slip)] == ["hello.txt", "sub/foo.txt"]
    many = zipped([(f"{i}.txt", b"x") for i in range(10_001)])
    with pytest.raises(ValueError):
        reader.archive_rows("zip", "huge.zip", many)
    assert containers.Budget(left=100).read(io.BytesIO(b"A" * 200)) is None
    deep = b"end"
    for i in range(14):
        deep = zipped([("n.zip" if i else "n.txt", deep)])
    rows = reader.archive_rows("zip", "n.zip", deep)
    assert max(d for _, _, d, _ in rows) == containers.MOST_DEPTH - 1


def test_one_budget_for_all_levels():
    big = zipped([("a.txt", b"x" * 20_000)])
    raw = zipped([("inner.zip", big), ("top.docx", zipped([("word/document.xml", b"<w:t>" + b"y" * 20_000 + b"</w:t>")])), ("end.txt", b"end")])
    budget = containers.Budget(left=50_000)
    rows = reader.archive_rows("zip", "r.zip", raw, budget=budget)
    assert [r[0] for r in rows] == ["a.txt", "inner.zip", "end.txt"] and 0 <= budget.left < 20_000  # what is larger than the rest goes
    small = containers.Budget(left=len(big) + 1500)
    names = [r[0] for r in reader.archive_rows("zip", "r.zip", zipped([("inner.zip", big), ("end.txt", b"end")]), budget=small)]
    assert names == ["inner.zip", "end.txt"] and small.left < 1500


def test_one_depth_for_archives_and_office_files():
    texts = lambda n: reader.read("n.zip", S.deep_zip("bottom", n), "archive").content
    assert "bottom" in texts(5) and "bottom" not in texts(25)
    assert texts(25).count("level") <= containers.MOST_DEPTH


def test_number_formats():
    golden = [(2.1, "General", "2.1"), (0.55, "0.00%", "55.00%"), (43711.0, "M/D/YY", "9/3/19"), (43711.550682870373, "MM/DD/YYYY\\ HH:MM:SS", "09/03/2019 13:12:59"), (1234.5, "#,##0.00", "1234.50"), (2.5, "0", "2"), (1e21, "General", "1000000000000000000000"), (1e-7, None, "0.0000001"), (3.0, 14, "3")]
    assert [legacy.number_text(x, f) for x, f, _ in golden] == [t for *_, t in golden]
    assert legacy.number_text(43711.0, 14, fixed=True) == "09/03/19"


def test_empty_workbook_fails():
    got = reader.safe_read("a.xls", S.xls(""), "xls")
    assert (got.status, got.error) == ("failed", "未找到Excel内容")


def test_presentations():
    raw = zipped([("ppt/slides/slide1.xml", b"<a:t></a:t>"), ("ppt/slides/slide2.xml", b"<a:t>two &amp; 2</a:t>"), ("ppt/embeddings/b.xlsx", S.xlsx(["cell"]))])
    assert office.pptx(raw) == "two & 2\ncell 0 " and office.pptx(raw, fixed=True) == "two & 2"
    assert reader.read("a.pptx", raw, "pptx").content == "two & 2\ncell 0 cell"


def test_open_armor():
    assert T.pgp_text(b"x\n-----BEGIN PGP A\nabc") == "-----BEGIN PGP A\nabc" and T.pgp_text(b"plain") == "plain"
    assert T.pgp_text(b"-----BEGIN PGP A\nabc\n-----END PGP A-----\nafter") == "-----BEGIN PGP A\nabc\n-----END PGP A-----\n"


def test_truncated_tar_ends():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n in ("a", "b"):
            i = tarfile.TarInfo(n + ".txt")
            i.size = 2000
            t.addfile(i, io.BytesIO(n.encode() * 2000))
    rows = reader.archive_rows("tar", "x.tar", out.getvalue()[:3000])
    assert [r[0] for r in rows] == ["a.txt"]


def test_seven_zip_lzma():
    import lzma

    data = b"hello seven " * 50
    packed = lzma.compress(data, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}])
    num = lambda n: bytes([n]) if n < 0x80 else bytes([0x80 | n >> 8, n & 255])
    names = "f.txt\0".encode("utf-16-le")
    header = b"\x01\x04" + b"\x06" + num(0) + num(1) + b"\x09" + num(len(packed)) + b"\x00" + b"\x07\x0b" + num(1) + b"\x00" + num(1) + b"\x21\x21" + num(1) + b"\x08" + b"\x0c" + num(len(data)) + b"\x00" + b"\x08\x00" + b"\x00" + b"\x05" + num(1) + b"\x11" + num(1 + len(names)) + b"\x00" + names + b"\x00\x00"
    raw = b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", 0) + struct.pack("<QQI", len(packed), len(header), zlib.crc32(header)) + packed + header
    assert [(m.name, m.data) for m in containers.members("7z", "a.7z", raw)] == [("f.txt", data)]


def test_stored_rar():
    name, data = b"f.txt", b"stored"
    block = lambda kind, flags, body, extra=b"": struct.pack("<HBHH", 0, kind, flags, 7 + len(body)) + body + extra
    head = struct.pack("<IIBIIBBHI", len(data), len(data), 0, 0, 0, 20, 0x30, len(name), 0) + name
    raw = b"Rar!\x1a\x07\x00" + block(0x73, 0, b"\0" * 6) + block(0x74, 0x8000, head, data) + block(0x7B, 0, b"")
    assert [(m.name, m.data) for m in containers.members("rar", "a.rar", raw)] == [("f.txt", data)]


def test_iso():
    block = 2048

    def entry(name, where, size, flags):
        n = 33 + len(name) + (1 - len(name) % 2)
        return (bytes([n, 0]) + struct.pack("<I", where) + struct.pack(">I", where) + struct.pack("<I", size) + struct.pack(">I", size) + b"\0" * 7 + bytes([flags, 0, 0]) + b"\0" * 4 + bytes([len(name)]) + name).ljust(n, b"\0")

    root = entry(b"\0", 18, block, 2) + entry(b"\1", 18, block, 2) + entry(b"A.TXT;1", 19, 5, 0)
    volume = bytearray(block)
    volume[:6] = b"\x01CD001"
    volume[40:45] = b"LABEL"
    volume[156 : 156 + 34] = entry(b"\0", 18, block, 2)
    raw = b"\0" * 16 * block + bytes(volume) + b"\0" * block + root.ljust(block, b"\0") + b"hello"
    assert [(m.name, m.data) for m in containers.members("iso", "a.iso", raw)] == [("A.TXT", b"hello")]


def test_rpm():
    store = b"pkg\x001.0\x00"
    index = struct.pack(">IIII", 1000, 6, 0, 1) + struct.pack(">IIII", 1001, 6, 4, 1)
    empty = b"\x8e\xad\xe8\x01" + b"\0" * 4 + struct.pack(">II", 0, 0)
    raw = b"\xed\xab\xee\xdb".ljust(96, b"\0") + empty + b"\x8e\xad\xe8\x01" + b"\0" * 4 + struct.pack(">II", 2, len(store)) + index + store
    assert containers.rpm_metadata(raw) == {"name": ["pkg"], "version": ["1.0"]}


def compound(streams):
    """A small compound file with the given streams in the mini stream or in sectors."""
    sector, body, fat, entries = 512, b"", [], []

    def add(data):
        nonlocal body
        start, n = len(fat), max(1, -(-len(data) // sector))
        body += data.ljust(n * sector, b"\0")
        fat.extend([start + i + 1 for i in range(n - 1)] + [0xFFFFFFFE])
        return start

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", start, size)

    for name, data in streams:
        entries.append(entry(name, 2, add(data.ljust(4096, b"\0")), max(4096, len(data))))
    directory = add(entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entries))
    fat_at = len(fat)
    fat.append(0xFFFFFFFD)
    body += struct.pack(f"<{len(fat)}I", *fat).ljust(sector, b"\xff")
    head = legacy.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", 1, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, fat_at)
    return head.ljust(512, b"\xff") + body


def biff(*records):
    return b"".join(struct.pack("<HH", k, len(b)) + b for k, b in records)


def test_xls_cells():
    def shared(s, cut=None):
        return struct.pack("<HB", len(s), 0) + s.encode()

    sst = struct.pack("<II", 2, 2) + shared("String 3") + struct.pack("<HB", 6, 0) + b"abc"
    book = biff((0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12), (0x41E, struct.pack("<HHB", 164, 5, 0) + b"0.00%"), (0xE0, struct.pack("<HH", 0, 0)), (0xE0, struct.pack("<HH", 0, 164)), (0xE0, struct.pack("<HH", 0, 14)), (0xFC, sst), (0x3C, b"\0def"), (0x0A, b""), (0x809, struct.pack("<HH", 0x600, 16) + b"\0" * 12), (0xFD, struct.pack("<HHHI", 0, 0, 0, 0)), (0xFD, struct.pack("<HHHI", 0, 1, 0, 1)), (0x203, struct.pack("<HHHd", 0, 2, 0, 2.1)), (0x203, struct.pack("<HHHd", 1, 0, 1, 0.55)), (0x203, struct.pack("<HHHd", 1, 1, 2, 43711.0)), (0x205, struct.pack("<HHHBB", 1, 2, 0, 7, 1)), (0x205, struct.pack("<HHHBB", 1, 3, 0, 1, 0)), (0xBD, struct.pack("<HHHIHIH", 2, 0, 0, 3 << 2 | 2, 0, 4 << 2 | 2, 1)), (0x0A, b""))
    raw = compound([("Workbook", book)])
    assert legacy.xls(raw) == "String 3 abcdef 2.1\n55.00% 43711 #DIV/0! TRUE\n3 4"
    assert legacy.xls(raw, fixed=True) == "String 3 abcdef 2.1\n55.00% 09/03/19 #DIV/0! TRUE\n3 4"
    locked = compound([("Workbook", biff((0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12), (0x2F, b"\0\0")))])
    assert legacy.ole_encrypted(locked, "xls") and not legacy.ole_encrypted(raw, "xls")
    with pytest.raises(containers.Encrypted):
        legacy.xls(locked)


def test_ppt_text():
    atom = lambda kind, body, v=0: struct.pack("<HHI", v, kind, len(body)) + body
    slides = atom(0x0FF0, atom(0x0FA0, "12345".encode("utf-16-le")) + atom(0x0FA8, b"six"), 0xF)
    raw = compound([("Current User", struct.pack("<HHIII", 0, 0xFF6, 20, 20, 0xE391C05F)), ("PowerPoint Document", atom(0x03E8, slides, 0xF))])
    assert legacy.ppt(raw) == "12345 six" and not legacy.ole_encrypted(raw, "ppt") and legacy.ole_encrypted(raw, "ppt", "reference")


def test_doc_text():
    text = "text-inside-doc\r"
    main = bytearray(2048)
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<I", main, 76, len(text))
    main[1024 : 1024 + len(text)] = text.encode()
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 1024 * 2 | 0x40000000, 0)
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    raw = compound([("WordDocument", bytes(main)), ("1Table", clx)])
    assert legacy.doc(raw) == "text-inside-doc" and not legacy.ole_encrypted(raw, "doc")
    main[11] |= 1
    assert legacy.ole_encrypted(compound([("WordDocument", bytes(main))]), "doc")


def test_office_modes():
    raw = zipped([("word/document.xml", '<w:p><w:t>a</w:t><w:t xml:space="preserve">b &amp; c</w:t></w:p>')])
    assert office.docx(raw) == "a\n" and office.docx(raw, fixed=True) == "ab & c"
    sheet = zipped([("xl/worksheets/sheet1.xml", '<c t="str"><v>s</v></c><c><v>4</v></c><c t="inlineStr"><is><t>in</t></is></c>')])
    assert office.xlsx(sheet) == "s" and office.xlsx(sheet, fixed=True) == "s 4 in"
    embedded = zipped([("word/document.xml", "<w:document/>"), ("word/embeddings/oleObject1.bin", bytes.fromhex("D0CF11E0A1B11AE1"))])
    assert reader.read("a.docx", embedded, "docx").content == "\n"


def test_pdf():
    raw = S.pdf("one (1)\ntwo")
    assert pdf.page_count(raw) == 1 and pdf.text(raw) == "one (1)\ntwo"
    with pytest.raises(containers.Encrypted):
        pdf.text(raw + b"/Encrypt 5 0 R")


def test_pdf_pages(spark):
    df = spark.createDataFrame([("a.pdf", S.pdf("one"))], "path string, content binary")
    assert [tuple(r) for r in X.pdf_pages(df, "last").collect()] == [("a.pdf", 1, "one")]
    assert X.pdf_pages(df, "2").count() == 0 and X.pdf_pages(df).count() == 1


def test_rtf():
    assert T.rtf_text(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 A;}}caf\'e9\par x\u8364?y}") == "café\nx€y"
    with pytest.raises(ValueError):
        T.rtf_text(b"text")


def test_text_functions():
    assert T.decode_text("中文".encode("gbk")) == "中文" and T.decode_text("\ufeffa".encode("utf-16-le"), fixed=True) == "a"
    assert T.utf16_units("a\U0001f600".encode("utf-16-le")) == "a\ufffd\ufffd"
    assert T.normalise_csv(b'a;"b;c";d\n1;2\n') == "a\tb;c\td\n1\t2"
    assert T.unescape("&lt;\\u0026\\uZZZZ") == "<&\\uZZZZ"


def test_media_sizes():
    assert media.dimensions(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert media.dimensions(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == (5, 6)
    assert media.dimensions(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 8, 7)) == (7, 8)
    assert media.dimensions(b"") is None and media.dimensions(None) is None


def test_model(spark):
    raws = [b"  abc def ghi \n", b"x" * 5000, b"", b"ab"]
    df = spark.createDataFrame([(r,) for r in raws], "c binary").select(model.features_column(F.col("c")), model.small_label(F.col("c")))
    rows = df.collect()
    assert [r[0] for r in rows] == [model.features(r) for r in raws]
    assert [r[1] for r in rows] == [None, None, "empty", "txt"]


def test_json_shapes(spark):
    df = spark.createDataFrame([("a.mp3", None, 1, b"x"), ("a.zzz", None, 1, b"x")], SCHEMA)
    out = X.extract(df)
    assert '"skipped":true' in X.to_json(out).first()[0]
    six = sorted(r[0] for r in X.to_json_six(out).collect())
    assert six == ['{"file_name":"a.mp3","file_type":"audio/mpeg","file_size":1,"status":"skipped","content":"","error_message":""}', '{"status":"failed","content":"","error_message":"文件类型不支持"}']


def test_files_stream_and_cache(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("alpha")
    (folder / "b.zip").write_bytes(zipped([("hello.txt", b"Hello World")]))
    results = X.extract(sources.read_files(spark, str(folder)))
    assert {r["file_name"]: r["content"] for r in results.collect()} == {"a.txt": "alpha", "b.zip": "=== hello.txt ===\nHello World\n\n"}
    sources.register(spark)
    heads = spark.read.format("filehead").option("path", str(folder)).option("bytes", 3).load()
    assert sorted(bytes(r["head"]) for r in heads.collect()) == [b"PK\x03", b"alp"]
    assert spark.sql("select extract_file('x.txt', cast('hi' as binary)).content").first()[0] == "hi"
    stream = ingest.extract_stream(ingest.once_each(ingest.read_stream(spark, str(folder))))
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("found").count() == 2
    files = sources.read_files(spark, str(folder))
    keyed = files.withColumn("key", T.cache_key(F.col("path"), F.unix_micros("modificationTime") * 1000, F.col("length"), F.lit("reference"), F.col("content")))
    cache = keyed.filter("path like '%a.txt'").select("key").crossJoin(results.filter("file_name = 'a.txt'").withColumn("content", F.lit("kept")))
    again = ingest.incremental(spark, files, cache)
    assert {r["file_name"]: r["content"] for r in again.collect()}["a.txt"] == "kept"
    sources.write_json(results, str(tmp_path / "json"))
    sources.write_texts(results, str(tmp_path / "texts"))
    assert len(list((tmp_path / "texts").glob("file=*"))) == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir(), out.mkdir()
    (folder / "a.txt").write_text("alpha")
    (folder / "m.mp3").write_bytes(b"abcd")
    sources.main(["version"])
    assert capsys.readouterr().out.startswith("excerpta ")
    sources.main(["--output", str(out), str(folder)])
    lines = sorted(capsys.readouterr().out.strip().splitlines())
    assert len(lines) == 2 and '"content":"alpha"' in lines[0] and '"skipped":true' in lines[1]
    assert [(p.name, p.read_text()) for p in out.iterdir()] == [("a.txt.txt", "alpha")]


def test_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(X, "OUT_CHARS", 10)
    schema = X.pa.schema([("content", X.pa.string())])
    sizes = [b.num_rows for b in X.sliced(({"content": "x" * n} for n in (4, 4, 4, 30, 1, 1)), "content", schema)]
    assert sizes == [3, 1, 2]
