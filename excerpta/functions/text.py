"""Text rules: Catalyst expressions, and plain Python functions for what has no built-in form (see ``udfs``)."""

from __future__ import annotations

import csv
import html
import io
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

csv.field_size_limit(1 << 30)
SEPARATORS = (",", ";", "\t", "|")
LOG_BYTES = 4096
# Windows code pages of RTF, and the text of its symbol words.
CODE_PAGES = {936: "gbk", 950: "big5", **{n: f"cp{n}" for n in range(1250, 1259)}}
RTF_SYMBOLS = {
    "bullet": "*", "emdash": "-", "endash": "-", "lquote": "'", "rquote": "'", "ldblquote": '"', "rdblquote": '"', "line": "\n", "par": "\n", "page": "\n", "sect": "\n", "tab": "\t", "cell": " ", "column": " ", "row": " ",
    "~": " ", "_": "-", "|": "|", "-": "-", ":": ":", "{": "{", "}": "}", "\\": "\\", "\n": "\n", "\r": "\n",
}
#: What ``fixed`` has instead: the signs that the words name, empty lines at sections and pages, bars between cells.
RTF_SIGNS = {
    "bullet": "\u2022", "emdash": "\u2014", "endash": "\u2013", "emspace": "\u2003", "enspace": "\u2002", "qmspace": "\u2005", "lquote": "\u2018", "rquote": "\u2019", "ldblquote": "\u201c", "rdblquote": "\u201d",
    "page": "\n\n", "sect": "\n\n", "cell": "|", "nestcell": "|", "row": "\n", "~": "\u00a0", "-": "\u00ad",
}
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "themedata", "datastore"}


# ---- Catalyst expressions -------------------------------------------------------------------------------


def valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def separator(line: Column) -> Column:
    """The commonest of comma, semicolon, tab and bar; of equals the earlier; none: comma."""
    n = [F.length(line) - F.length(F.replace(line, F.lit(s), F.lit(""))) for s in SEPARATORS]
    best = F.greatest(*n)
    return reduce(lambda c, i: c.when((n[i] == best) & (n[i] > 0), SEPARATORS[i]), range(1, 4), F.when((n[0] == best) | (best == 0), ",")).otherwise(",")


def tag_text(xml: Column, tag: str = "w:t", attributes: bool = False) -> Column:
    """Text between the literal start and end tags, joined without separators. ``attributes``: start tags may have some."""
    start = rf"<{tag}(?:\s[^>]*)?>" if attributes else f"<{tag}>"
    return F.array_join(F.regexp_extract_all(xml, F.lit(rf"(?s){start}(.*?)</{tag}>"), F.lit(1)), "")


def strip_tags(xml: Column) -> Column:
    """Text outside of tags: stray ``>`` dropped, no blanks after a tag, other blanks collapsed, trimmed."""
    mark = F.chr(F.lit(1))
    marked = F.replace(F.regexp_replace(xml, F.lit("<[^>]*(>|$)"), mark), F.lit(">"), F.lit(""))
    bare = F.regexp_replace(marked, "(^|\x01)[\x01 \t\r\n]*", "")
    return F.regexp_replace(F.regexp_replace(bare, "[ \t\r\n]+", " "), r"(?U)^\s+|\s+$", "")


def pgp_slice(text: Column) -> Column:
    """From the armor's first line through the end of its last one, or to the end if it has none; without armor the first MiB."""
    block = F.regexp_extract(text, r"(?s)(-----BEGIN PGP.*?-----END PGP[^\n]*\n?)", 1)
    at = F.instr(text, F.lit("-----BEGIN PGP"))
    return F.when(block != "", block).when(at > 0, F.substring(text, at, F.length(text))).otherwise(F.substring(text, 1, 1 << 20))


def is_number(text: Column) -> Column:
    """Whether a text is digits only."""
    return F.coalesce(text.rlike("^[0-9]+$") & ~F.contains(text, F.lit("\n")), F.lit(False))


def pgp_binary(content: Column) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 1)).isin("85", "C0", "C3", "C6"), F.lit(False))


def truncate_log(text: Column) -> Column:
    return F.when(F.octet_length(text) > LOG_BYTES, F.concat(F.substring(text.cast("binary"), 1, LOG_BYTES).cast("string"), F.lit("...[truncated]"))).otherwise(text)


def member_fallback(name: Column, content: Column) -> Column:
    """What stands for a member that no extractor reads."""
    from .detect import printable

    size = F.coalesce(F.length(content), F.lit(0)).cast("string")
    note = lambda tail: F.concat(F.lit("[文件: "), name, F.lit(", 大小: "), size, F.lit(tail))
    return F.when(size == "0", note(" 字节]")).when(printable(content), content.cast("string")).otherwise(note(" 字节 (二进制或非文本文件)]"))


def metadata_block(name: Column, type_: Column, size: Column, modified: Column, content: Column, most_hashed: int = 64 << 20) -> Column:
    """Name, size, type, time of change and SHA-256 (up to 64 MiB), each on a line."""
    lines = [F.lit("[file metadata]"), F.concat(F.lit("name: "), name), F.concat(F.lit("size: "), size.cast("string"), F.lit(" bytes")), F.concat(F.lit("type: "), type_), F.concat(F.lit("modified: "), F.date_format(modified, "yyyy-MM-dd HH:mm:ss"))]
    return F.concat(F.concat_ws("\n", *lines, F.when(size <= most_hashed, F.concat(F.lit("sha256: "), F.sha2(content, 256)))), F.lit("\n"))


def cache_key(path: Column, modified_ns: Column, size: Column, ocr: Column, content: Column) -> Column:
    """path:time:size:ocr:first 16 hex digits of the SHA-1 of the first 64 KiB."""
    return F.concat_ws(":", path, modified_ns.cast("string"), size.cast("string"), ocr.cast("string"), F.substring(F.sha1(F.substring(content, 1, 65536)), 1, 16))


def member_name(name: Column) -> Column:
    """Clean relative path of an archive member; null where it is empty, absolute, on a drive, or leaves the archive."""
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))), "/")
    bad = (F.size(parts) == 0) | slashed.rlike("^/|^[A-Za-z]:") | (depth["least"] < 0) | (clean == "") | F.contains(name, F.chr(F.lit(0)))
    return F.when(~bad, clean)


def page_range(spec: Column, pages: Column) -> Column:
    """Page numbers of a range like ``1-3,last,r2``: ``rN`` counts back from the last page, spans may be reversed, first mention counts.

    Null where a part is malformed or outside of the document.
    """

    def one(t: Column) -> Column:
        return F.when(t == "first", 1).when(t == "last", pages).when(t.rlike(r"^r[0-9]{1,6}$"), pages - F.substring(t, 2, 6).try_cast("int")).when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int"))

    def span(p: Column) -> Column:
        ends = F.split(p, "-")
        a, b = one(F.trim(F.get(ends, F.lit(0)))), one(F.trim(F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))))
        good = (F.size(ends) <= 2) & a.between(1, pages) & b.between(1, pages)
        return F.when(good, F.sequence(F.least(a, b), F.greatest(a, b)))

    parts = F.transform(F.split(F.lower(F.trim(spec)), ","), lambda p: span(F.trim(p)))
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_distinct(F.flatten(parts)))


# ---- Python functions on single values ------------------------------------------------------------------


def decode_text(raw: bytes | None, fixed: bool = False) -> str:
    """UTF-8 if valid, else GBK with replacement. ``fixed``: byte order marks decide first, then GB18030 if it is valid."""
    raw = raw or b""
    if fixed:
        for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if raw.startswith(mark):
                return raw[len(mark) :].decode(codec, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if fixed:
        try:
            return raw.decode("gb18030")
        except UnicodeDecodeError:
            pass
    return raw.decode("gbk", "replace")


def utf16_units(raw: bytes) -> str:
    """Little-endian UTF-16 by code unit; lone and paired surrogates become replacement characters, an odd last byte goes."""
    units = memoryview(raw[: len(raw) // 2 * 2]).cast("H")
    return "".join("\ufffd" if 0xD800 <= u < 0xE000 else chr(u) for u in units)


def normalise_csv(raw: bytes | None) -> str:
    """Records as lines, a line end between them, fields separated by tabs. The separator is the commonest candidate in the raw bytes."""
    raw = raw or b""
    counts = [raw.count(s.encode()) for s in SEPARATORS]
    sep = SEPARATORS[max(range(4), key=lambda i: (counts[i], -i))]
    rows = csv.reader(io.StringIO(decode_text(raw).replace("\0", ""), newline=""), delimiter=sep)
    return "\n".join("\t".join(r) for r in rows if r)


def pgp_text(raw: bytes) -> str:
    """``pgp_slice`` of a file's bytes; armor must begin in the first MiB."""
    begin = raw[: 1 << 20].find(b"-----BEGIN PGP")
    if begin < 0:
        return raw[: 1 << 20].decode("utf-8", "replace")
    last = raw.find(b"-----END PGP", begin)
    stop = raw.find(b"\n", last) + 1 if last >= 0 else 0
    return raw[begin : stop or (last + len(b"-----END PGP") if last >= 0 else len(raw))].decode("utf-8", "replace")


def unescape(text: str | None) -> str:
    """HTML entities, then JSON-style escapes of one character; malformed ones stay."""
    return re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), html.unescape(text or ""))


def rtf_text(raw: bytes | None, fixed: bool = False) -> str:
    """Text of an RTF document in document order. Raises ValueError for what does not start like one. ``fixed``: symbol words give the signs they name."""
    data = (raw or b"").decode("latin-1")
    symbols = RTF_SYMBOLS | RTF_SIGNS if fixed else RTF_SYMBOLS
    if not data.lstrip().startswith("{\\rtf"):
        raise ValueError("not RTF")
    out: list[str] = []
    held = bytearray()
    codec, unicode_skip, skip_left = "gbk", 1, 0
    stack: list[tuple[bool, int]] = []
    skipping = False

    def flush() -> None:
        if held:
            out.append(bytes(held).decode(codec, "replace"))
            held.clear()

    for m in re.finditer(r"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|([^\\{}]+)", data):
        word, number, code, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((skipping, unicode_skip))
        elif brace == "}":
            if stack:
                skipping, unicode_skip = stack.pop()
        elif word is not None:
            if word in _RTF_SKIP:
                skipping = True
            elif word == "ansicpg" and number:
                flush()
                codec = CODE_PAGES.get(int(number), codec)
            elif word == "uc" and number:
                unicode_skip = max(0, int(number))
            elif word == "u" and number and not skipping:
                flush()
                out.append(chr(int(number) % 65536))
                skip_left = unicode_skip
            elif word in symbols and not skipping:
                flush()
                out.append(symbols[word])
        elif symbol is not None:
            if symbol == "*":
                skipping = True
            elif symbol in symbols and not skipping:
                flush()
                out.append(symbols[symbol])
        elif code is not None:
            if skip_left:
                skip_left -= 1
            elif not skipping:
                held.append(int(code, 16))
        elif not skipping:
            plain = plain.replace("\r", "").replace("\n", "")
            taken, skip_left = plain[skip_left:], max(0, skip_left - len(plain))
            held += taken.encode("latin-1")
    flush()
    text = "".join(out)
    # surrogate pairs written as two escapes
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
