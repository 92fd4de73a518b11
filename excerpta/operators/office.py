"""Office documents in zip containers: texts of Word, PowerPoint, Excel, binary Excel, OpenDocument and Visio, and what is embedded in them.

``mode='reference'`` keeps the narrow rules that published outputs follow (only plain start tags, only string
cells); ``mode='fixed'`` reads tags with attributes, numbers and inline strings.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

from ..functions.text import unescape
from .containers import MOST_ENTRIES, Budget

EMBED_DEPTH = 3
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".gif")


def parts(raw: bytes, wanted, budget: Budget | None = None) -> Iterator[tuple[str, bytes]]:
    """(name, data) of the entries that ``wanted`` takes, in zip order, within what the outermost file may still unpack."""
    budget = budget or Budget()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if len(z.infolist()) > MOST_ENTRIES:
            raise ValueError("too many entries")
        for i in z.infolist():
            if wanted(i.filename) and not i.is_dir():
                with z.open(i) as f:
                    data = budget.read(f, i.file_size)
                if data is not None:
                    yield i.filename, data


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _tagged(xml: str, tag: str, fixed: bool) -> str:
    start = rf"<{tag}(?:\s[^>]*)?(?<!/)>" if fixed else f"<{tag}>"
    return "".join(re.findall(rf"(?s){start}(.*?)</{tag}>", xml))


def strip_tags(xml: str) -> str:
    """Text outside of tags, as ``functions.text.strip_tags`` has it."""
    bare = re.sub("(^|\x01)[\x01 \t\r\n]*", "", re.sub("<[^>]*(>|$)", "\x01", xml).replace(">", ""))
    return re.sub("[ \t\r\n]+", " ", bare).strip()


def kind_of(raw: bytes) -> str:
    """docx, xlsx, pptx or odt by the first entry that tells; empty if none does."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for n in z.namelist():
            for mark, kind in (("xl/", "xlsx"), ("word/", "docx"), ("ppt/", "pptx")):
                if mark in n:
                    return kind
        return "odt" if "content.xml" in z.namelist() else ""


def docx(raw: bytes, fixed: bool = False, budget: Budget | None = None) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if "content.xml" in z.namelist():
            return odt(raw, budget)
    found = [_text(data) for _, data in parts(raw, lambda n: n.startswith("word/document.xml"), budget)]
    if fixed:
        return "\n".join("\n".join(unescape(_tagged(p, "w:t", True)) for p in xml.split("</w:p>")).rstrip("\n") for xml in found).strip()
    return "".join(_tagged(xml, "w:t", False) + "\n" for xml in found)


def odt(raw: bytes, budget: Budget | None = None) -> str:
    return "".join(strip_tags(_text(data)) for _, data in parts(raw, lambda n: n == "content.xml", budget))


def pptx(raw: bytes, fixed: bool = False, budget: Budget | None = None) -> str:
    """Texts of the slides that have any, a line end after each, then values and strings of embedded workbooks, blanks after them."""
    slides = list(parts(raw, lambda n: n.startswith("ppt/slides/slide") and n.endswith(".xml"), budget))
    if fixed:
        slides.sort(key=lambda p: [int(x) for x in re.findall(r"\d+", p[0])[-1:]])
    out = [unescape(text) + "\n" for _, data in slides if (text := _tagged(_text(data), "a:t", fixed))]
    if not fixed:  # else they are read as embedded objects
        for _, book in parts(raw, lambda n: n.startswith("ppt/embeddings/") and n.endswith(".xlsx"), budget):
            try:
                sheets = [_text(d) for _, d in parts(book, lambda n: any(x in n for x in ("sharedStrings.xml", "sheet1.xml", "sheet2.xml", "sheet3.xml")), budget)]
            except (zipfile.BadZipFile, ValueError):
                continue
            out += [x for xml in sheets for x in _dump(xml)]
    return "".join(out).strip() if fixed else "".join(out)


def _dump(xml: str) -> list[str]:
    """All values, then all strings, each run followed by a blank."""
    return [unescape(text) + " " for tag in ("v", "t") if (text := _tagged(xml, tag, False))]


def vsdx(raw: bytes, fixed: bool = False, budget: Budget | None = None) -> str:
    found = parts(raw, lambda n: n.startswith("visio/pages/page") and n.endswith(".xml"), budget)
    if fixed:
        return "\n".join(strip_tags("".join(re.findall(r"(?s)<Text(?:\s[^>]*)?>.*?</Text>", _text(d)))) for _, d in found).strip()
    return "\n".join(_tagged(_text(d), "w:t", False) for _, d in found).strip()


_RUN, _KIND, _VALUE = re.compile(r"(?s)<t(?:\s[^>]*)?(?<!/)>(.*?)</t>"), re.compile(r'\bt="(\w+)"'), re.compile(r"(?s)<v(?:\s[^>]*)?>(.*?)</v>")
#: A shared string that is one plain run, or its body; a cell that is one plain value, or its body.
_SHARED = re.compile(r"(?s)<si>(?:<t>([^<]+)</t></si>|(.*?)</si>)")
_CELL = re.compile(r"(?s)<c(\s[^>]*?)?(?<!/)>(?:<v>([^<]+)</v></c>|(.*?)</c>)")


def _shared_strings(xml: str, fixed: bool) -> list[str]:
    out = []
    for whole, body in _SHARED.findall(xml):
        if body:
            runs = _RUN.findall(body)
            whole = "".join(runs if fixed else runs[:1])
        out.append(unescape(whole) if fixed and ("&" in whole or "\\" in whole) else whole)
    return out


def _cells(xml: str, strings: list[str], fixed: bool) -> list[str]:
    out = []
    for attributes, value, body in _CELL.findall(xml):
        if body:
            found = _VALUE.search(body)
            value = found[1] if found else None
        elif not value:
            value = None
        if ' t="s"' in attributes:
            if value and (value.isdigit() or value.strip().isdigit()) and int(value) < len(strings):
                out.append(strings[int(value)])
            continue
        kind = (_KIND.search(attributes) or ("", "n"))[1]
        if kind == "s":
            if value and value.strip().isdigit() and int(value) < len(strings):
                out.append(strings[int(value)])
        elif kind == "str" and value is not None:
            out.append(unescape(value))
        elif fixed and kind == "inlineStr":
            out.append(unescape("".join(_RUN.findall(body))))
        elif fixed and value is not None:
            out.append({"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value)
    return out


def xlsx(raw: bytes, fixed: bool = False, budget: Budget | None = None) -> str:
    strings: list[str] = []
    for _, data in parts(raw, lambda n: n == "xl/sharedStrings.xml", budget):
        strings += _shared_strings(_text(data), fixed)
    sheets = [" ".join(_cells(_text(data), strings, fixed)) for _, data in parts(raw, lambda n: n.startswith("xl/worksheets/sheet") and n.endswith(".xml"), budget)]
    text = "\n".join(sheets).strip()
    if not text:
        text = "".join(x for _, d in parts(raw, lambda n: "xl/" in n and n.endswith(".xml"), budget) for x in _dump(_text(d))).strip()
    return text


def _records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(id, body) of BIFF12 records: variable-length id and size."""
    at = 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind & 0x80 and at < len(data):
            kind |= data[at] << 8
            at += 1
        size = 0
        for i in range(4):
            if at >= len(data):
                return
            b = data[at]
            at += 1
            size |= (b & 0x7F) << 7 * i
            if not b & 0x80:
                break
        yield kind, data[at : at + size]
        at += size


def _wide(body: bytes, at: int) -> str:
    n = struct.unpack_from("<I", body, at)[0]
    return body[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "ignore").replace("\0", "")


def rk_number(v: int) -> float:
    """A packed number: 30-bit integer or the top of a float, perhaps in hundredths."""
    x = float((v >> 2) - (1 << 30 if v >> 31 else 0)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def xlsb(raw: bytes, fixed: bool = False, budget: Budget | None = None) -> str:
    strings = [_wide(b, 1) for _, d in parts(raw, lambda n: n == "xl/sharedStrings.bin", budget) for k, b in _records(d) if k == 0x13 and len(b) >= 5]
    sheets = []
    for _, data in parts(raw, lambda n: n.startswith("xl/worksheets/sheet") and n.endswith(".bin"), budget):
        cells = []
        for kind, b in _records(data):
            try:
                if kind == 7:
                    cells.append(strings[struct.unpack_from("<I", b, 8)[0]])
                elif kind == 6:
                    cells.append(_wide(b, 8))
                elif kind == 5:
                    cells.append(f"{struct.unpack_from('<d', b, 8)[0]:.15g}")
                elif kind == 4:
                    cells.append("TRUE" if b[8] else "FALSE")
                elif kind == 2 and fixed:
                    cells.append(f"{rk_number(struct.unpack_from('<I', b, 8)[0]):.15g}")
            except (struct.error, IndexError):
                continue
        sheets.append(" ".join(c for c in cells if c))
    return "\n".join(sheets).strip()


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "xlsb": xlsb}


def embedded(raw: bytes, budget: Budget | None = None) -> Iterator[tuple[str, bytes]]:
    """(name, data) of embedded objects; an object wrapped in a compound file gives the PDF in it, if there is one."""
    for name, data in parts(raw, lambda n: re.match(r"(word|ppt|xl)/embeddings/", n) is not None, budget):
        base = name.rsplit("/", 1)[-1]
        if data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
            inner = kind_of(data) if data[:4] == b"PK\x03\x04" else ""
            yield f"{base}.{inner or 'zip'}" if not base.lower().endswith((".docx", ".xlsx", ".pptx")) else base, data
        elif data[:4] == b"%PDF":
            yield base + ".pdf", data
        elif data[:4] == b"\xd0\xcf\x11\xe0":
            a, b = data.find(b"%PDF"), data.rfind(b"%%EOF")
            if 0 <= a < b:
                yield base + ".pdf", data[a : b + 5]


def media(raw: bytes, budget: Budget | None = None) -> Iterator[tuple[str, bytes]]:
    """(name, data) of pictures, for OCR."""
    yield from parts(raw, lambda n: re.match(r"(word|ppt|xl)/media/|Pictures/", n) is not None and n.lower().endswith(IMAGES), budget)
