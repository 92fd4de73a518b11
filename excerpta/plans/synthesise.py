"""Containers built from table texts, so that extraction can be held against the texts it started from."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import struct
import tarfile
import zipfile
import zlib
from xml.sax.saxutils import escape


def _zipped(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _tarred(entries: list[tuple[str, bytes]], mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def two_members(text: str) -> list[tuple[str, bytes]]:
    return [("a.txt", text.encode()), ("sub/b.txt", b"second " + text.encode())]


def docx(text: str) -> bytes:
    return _zipped([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", f"<w:document><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>".encode())])


def odt(text: str) -> bytes:
    return _zipped([("mimetype", b"application/vnd.oasis.opendocument.text"), ("content.xml", f"<office:text><text:p>{text}</text:p></office:text>".encode())])


def pptx(text: str) -> bytes:
    return _zipped([("ppt/slides/slide1.xml", f"<p:sld><a:t>{escape(text)}</a:t></p:sld>".encode()), ("ppt/slides/slide2.xml", b"<p:sld><a:t>end</a:t></p:sld>")])


def xlsx(words: list[str]) -> bytes:
    shared = "".join(f"<si><t>{escape(w)}</t></si>" for w in words)
    cells = "".join(f'<c r="A{i + 1}" t="s"><v>{i}</v></c>' for i in range(len(words)))
    return _zipped([("xl/sharedStrings.xml", f"<sst>{shared}</sst>".encode()), ("xl/worksheets/sheet1.xml", f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>".encode())])


def xlsb(words: list[str]) -> bytes:
    def record(kind: int, body: bytes) -> bytes:
        head = bytes([kind]) if kind < 128 else bytes([kind & 0xFF, kind >> 8])
        size, n = b"", len(body)
        while True:
            size += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                return head + size + body

    wide = lambda w: struct.pack("<I", len(w.encode("utf-16-le")) // 2) + w.encode("utf-16-le")
    shared = b"".join(record(0x13, b"\0" + wide(w)) for w in words)
    cells = b"".join(record(7, struct.pack("<III", i, 0, i)) for i in range(len(words)))
    return _zipped([("xl/sharedStrings.bin", shared), ("xl/worksheets/sheet1.bin", cells)])


def rtf(text: str) -> bytes:
    body = text.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}").replace("\n", "\\par ")
    return b"{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}\\f0 " + b"".join(c.encode() if ord(c) < 128 else b"\\u%d?" % (ord(c) if ord(c) < 32768 else ord(c) - 65536) for c in body) + b"}"


def pdf(text: str) -> bytes:
    """One page, one line of text a line."""
    lines = text.split("\n")
    quoted = lambda s: s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    ops = "BT /F1 12 Tf " + " T* ".join(f"({quoted(x)}) Tj" for x in lines) + " ET"
    stream = ops.encode("cp1252", "replace")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


# ---- compound files -------------------------------------------------------------------------------------


def compound(streams: list[tuple[str, bytes]]) -> bytes:
    """A compound file with these streams in whole sectors."""
    sector, body, fat = 512, [], []

    def add(data: bytes) -> int:
        start, n = len(fat), max(1, -(-len(data) // sector))
        body.append(data.ljust(n * sector, b"\0"))
        fat.extend([*range(start + 1, start + n), 0xFFFFFFFE])
        return start

    def entry(name: str, kind: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)

    entries = [entry(name, 2, add(data.ljust(4096, b"\0")), max(4096, len(data))) for name, data in streams]
    directory = add(entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entries))
    n_fat = 1
    while (len(fat) + n_fat) * 4 > n_fat * sector:
        n_fat += 1
    places = list(range(len(fat), len(fat) + n_fat))
    table = struct.pack(f"<{len(fat) + n_fat}I", *fat, *[0xFFFFFFFD] * n_fat).ljust(n_fat * sector, b"\xff")
    first, rest = places[:109], places[109:]
    more = [rest[i : i + 127] for i in range(0, len(rest), 127)]
    difat = [struct.pack(f"<{len(x)}I", *x).ljust(508, b"\xff") + struct.pack("<I", places[-1] + 2 + i if i + 1 < len(more) else 0xFFFFFFFE) for i, x in enumerate(more)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIIII", n_fat, directory, 0, 4096, 0xFFFFFFFE, 0, places[-1] + 1 if more else 0xFFFFFFFE, len(more), first[0]) + struct.pack(f"<{len(first) - 1}I", *first[1:])
    return head.ljust(512, b"\xff") + b"".join(body) + table + b"".join(difat)


def _biff(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


_GLOBALS, _SHEET, _EOF = _biff(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12), _biff(0x809, struct.pack("<HH", 0x600, 16) + b"\0" * 12), _biff(0x0A, b"")


def xls(text: str, locked: bool = False) -> bytes:
    """Lines as rows, words as label cells."""
    cells = []
    for row, line in enumerate(text.split("\n")):
        for column, w in enumerate(re.findall("[^ \t\r]+", line)):
            raw = w.encode("utf-16-le")
            cells.append(_biff(0x204, struct.pack("<HHHHB", row, column, 0, len(raw) // 2, 1) + raw))
    return compound([("Workbook", _GLOBALS + (_biff(0x2F, b"\0\0") if locked else b"") + _EOF + _SHEET + b"".join(cells) + _EOF)])


def xls_numbers(formats: list[str], numbers: list[float]) -> bytes:
    """One row of numbers, each in its own custom format; an empty one is built-in format 0."""
    head = b"".join(_biff(0x41E, struct.pack("<HHB", 164 + i, len(f), 0) + f.encode("latin-1")) for i, f in enumerate(formats))
    styles = b"".join(_biff(0xE0, struct.pack("<HH", 0, 164 + i if f else 0)) for i, f in enumerate(formats))
    cells = b"".join(_biff(0x203, struct.pack("<HHHd", 0, i, i, x)) for i, x in enumerate(numbers))
    return compound([("Workbook", _GLOBALS + head + styles + _EOF + _SHEET + cells + _EOF)])


def doc(text: str, locked: bool = False) -> bytes:
    """The text in one piece of 16-bit units."""
    raw = text.replace("\n", "\r").encode("utf-16-le")
    main = bytearray(2048) + raw
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 10, 0x300 if locked else 0x200)
    struct.pack_into("<I", main, 76, len(raw) // 2)
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(raw) // 2) + struct.pack("<HIH", 0, 2048, 0)
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    return compound([("WordDocument", bytes(main)), ("1Table", clx)])


def ppt(text: str, locked: bool = False) -> bytes:
    """The text as one atom of the slides' text list."""
    atom = lambda kind, body, v=0: struct.pack("<HHI", v, kind, len(body)) + body
    slides = atom(0x0FF0, atom(0x0FA0, text.replace("\n", "\r").encode("utf-16-le")), 0xF)
    user = struct.pack("<HHIII", 0, 0xFF6, 20, 20, 0xF3D1C4DF if locked else 0xE391C05F)
    return compound([("Current User", user), ("PowerPoint Document", atom(0x03E8, slides, 0xF))])


# ---- other containers -----------------------------------------------------------------------------------


def seven(data: bytes, name: str = "f.txt") -> bytes:
    """One member in LZMA2."""
    packed = lzma.compress(data, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}])
    num = lambda n: bytes([n]) if n < 0x80 else b"\xff" + struct.pack("<Q", n)
    names = (name + "\0").encode("utf-16-le")
    streams = b"\x06" + num(0) + num(1) + b"\x09" + num(len(packed)) + b"\x00" + b"\x07\x0b" + num(1) + b"\x00" + num(1) + b"\x21\x21" + num(1) + b"\x08" + b"\x0c" + num(len(data)) + b"\x00" + b"\x08\x00" + b"\x00"
    header = b"\x01\x04" + streams + b"\x05" + num(1) + b"\x11" + num(1 + len(names)) + b"\x00" + names + b"\x00\x00"
    return b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", 0) + struct.pack("<QQI", len(packed), len(header), zlib.crc32(header)) + packed + header


def rar(data: bytes, name: bytes = b"f.txt") -> bytes:
    """One stored member in a version 4 archive."""
    block = lambda kind, flags, body, extra=b"": struct.pack("<HBHH", 0, kind, flags, 7 + len(body)) + body + extra
    head = struct.pack("<IIBIIBBHI", len(data), len(data), 0, 0, 0, 20, 0x30, len(name), 0) + name
    return b"Rar!\x1a\x07\x00" + block(0x73, 0, b"\0" * 6) + block(0x74, 0x8000, head, data) + block(0x7B, 0, b"")


def rpm(text: str) -> bytes:
    """A package without payload; the text is its description."""
    values = [(1000, 6, [b"pkg"]), (1001, 6, [b"1.0"]), (1002, 6, [b"2"]), (1004, 9, [b"short"]), (1005, 9, [text.encode()]), (1006, 4, [86400]), (1009, 4, [12]), (1014, 6, [b"MIT"]), (1022, 6, [b"noarch"]), (1047, 8, [b"pkg"]), (1048, 4, [12, 0]), (1049, 8, [b"lib", b"sh"]), (1050, 8, [b"3", b""]), (1112, 4, [8]), (1113, 8, [b"1.0-2"])]
    store, index = b"", b""
    for tag, kind, own in values:
        if kind == 4:
            store += b"\0" * (-len(store) % 4)
        index += struct.pack(">IIII", tag, kind, len(store), len(own))
        store += struct.pack(f">{len(own)}I", *own) if kind == 4 else b"".join(x + b"\0" for x in own)
    head = b"\x8e\xad\xe8\x01" + b"\0" * 4
    return b"\xed\xab\xee\xdb".ljust(96, b"\0") + head + struct.pack(">II", 0, 0) + head + struct.pack(">II", len(values), len(store)) + index + store


def iso(data: bytes) -> bytes:
    """A volume named LABEL with one file."""
    block = 2048

    def entry(name: bytes, where: int, size: int, flags: int) -> bytes:
        n = 33 + len(name) + (1 - len(name) % 2)
        both = lambda x: struct.pack("<I", x) + struct.pack(">I", x)
        return (bytes([n, 0]) + both(where) + both(size) + b"\0" * 7 + bytes([flags, 0, 0]) + b"\0" * 4 + bytes([len(name)]) + name).ljust(n, b"\0")

    volume = bytearray(block)
    volume[:6], volume[40:72] = b"\x01CD001", b"LABEL".ljust(32)
    volume[156:190] = entry(b"\0", 18, block, 2)
    root = entry(b"\0", 18, block, 2) + entry(b"\1", 18, block, 2) + entry(b"A.TXT;1", 19, len(data), 0)
    return b"\0" * 16 * block + bytes(volume) + b"\0" * block + root.ljust(block, b"\0") + data


def png(width: int, height: int) -> bytes:
    """The first bytes of a picture."""
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\x08\x02\0\0\0"


def deep_zip(text: str, levels: int = 25) -> bytes:
    """A text under alternating levels of zip archives and Word documents."""
    data, name = text.encode(), "n.txt"
    for i in range(levels):
        if i % 2:
            data, name = _zipped([("word/document.xml", b"<w:t>level</w:t>"), ("word/embeddings/inner.bin", data)]), "n.docx"
        else:
            data, name = _zipped([(name, data)]), "n.zip"
    return data


BUILDERS = {
    "txt": lambda t: t.encode(),
    "docx": docx,
    "odt": odt,
    "pptx": pptx,
    "xlsx": lambda t: xlsx(t.split()),
    "xlsb": lambda t: xlsb(t.split()),
    "rtf": rtf,
    "pdf": pdf,
    "zip": lambda t: _zipped(two_members(t)),
    "tar": lambda t: _tarred(two_members(t), "w:"),
    "tar.gz": lambda t: _tarred(two_members(t), "w:gz"),
    "tar.bz2": lambda t: _tarred(two_members(t), "w:bz2"),
    "tar.xz": lambda t: _tarred(two_members(t), "w:xz"),
    "gz": lambda t: gzip.compress(t.encode()),
    "bz2": lambda t: bz2.compress(t.encode()),
    "xz": lambda t: lzma.compress(t.encode()),
    "nested.zip": lambda t: _zipped([("inner.zip", _zipped(two_members(t))), ("top.txt", t.encode())]),
    "slip.zip": lambda t: _zipped([("../out.txt", b"out"), ("in.txt", t.encode())]),
    "xls": xls,
    "doc": doc,
    "ppt": ppt,
    "7z": lambda t: seven(b"seven " + t.encode()),
    "rar": lambda t: rar(b"rar " + t.encode()),
    "rpm": rpm,
    "iso": lambda t: iso(b"iso " + t.encode()),
    "deep.zip": deep_zip,
    "sheet.pptx": lambda t: _zipped([("ppt/slides/slide1.xml", b"<p:sld></p:sld>"), ("ppt/slides/slide2.xml", f"<p:sld><a:t>{escape(t)}</a:t></p:sld>".encode()), ("ppt/embeddings/book.xlsx", xlsx(["cell"]))]),
    "embedded.docx": lambda t: _zipped([("word/document.xml", f"<w:t>{t}</w:t>".encode()), ("word/embeddings/sheet.xlsx", xlsx(t.split()))]),
}
