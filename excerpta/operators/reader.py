"""One value in, one reading out: dispatch of contents to extractors, with nesting under true depth limits."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from ..functions import text as T
from ..functions.types import extractor_map
from . import containers, legacy, media, office, pdf

NEED_TEXT = {"pdf": "未提取到文本内容", "xls": "未找到Excel内容", "xlsx": "未找到Excel内容"}


@dataclass
class Reading:
    """What a file gave."""

    status: str = "success"
    content: str = ""
    error: str = ""
    encrypted: bool = False
    skipped: bool | None = None


def extension(name: str) -> str:
    base = posixpath.basename(name.replace("\\", "/")).lower()
    m = re.search(r"\.(tar\.(?:gz|xz|bz2))$", base) or re.search(r"\.([^.]*)$", base)
    return m[1] if m else ""


def _sniff(raw: bytes) -> str:
    if len(raw) < 10:
        return ""
    if raw[257:262] == b"ustar":
        return "tar"
    for mark, kind in ((b"PK\x03\x04", "zip"), (b"%PDF", "pdf"), (b"\xd0\xcf\x11\xe0", "doc"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"Rar!", "rar")):
        if raw.startswith(mark):
            return kind
    return "txt" if printable(raw) else ""


def printable(raw: bytes) -> bool:
    head = raw[:1000]
    good = sum(32 <= b <= 126 or b in (9, 10, 13) for b in head)
    return bool(head) and good * 10 >= len(head) * 8


def fallback(name: str, raw: bytes) -> str:
    if not raw:
        return f"[文件: {name}, 大小: 0 字节]"
    return T.decode_text(raw) if printable(raw) else f"[文件: {name}, 大小: {len(raw)} 字节 (二进制或非文本文件)]"


def archive_rows(kind: str, name: str, raw: bytes, mode: str = "reference", depth: int = 0, budget: containers.Budget | None = None) -> list[tuple[str, bool, int, str]]:
    """(path, is_dir, depth, text) of all members, those of nested archives before the row that counts them."""
    if depth >= containers.MOST_DEPTH:
        raise ValueError(f"压缩包层级超过最大深度 {containers.MOST_DEPTH}")
    budget = budget or containers.Budget()
    out: list[tuple[str, bool, int, str]] = []
    for m in containers.members(kind, posixpath.basename(name), raw, budget):
        if m.is_dir:
            out.append((m.name, True, depth, ""))
            continue
        if m.data is None:
            out.append((m.name, False, depth, m.text or ""))
            continue
        ext = extension(m.name)
        inner = ext if ext in containers.NESTED else ""
        if inner and m.data:
            try:
                nested = archive_rows(inner, m.name, m.data, mode, depth + 1, budget.nested())
                out += nested
                out.append((m.name, False, depth, f"[嵌套压缩包: {len(nested)} 个文件]"))
                continue
            except Exception:  # not what its name says: read it like any other member
                out.append((m.name, False, depth, fallback(m.name, m.data)))
                continue
        out.append((m.name, False, depth, (m.text or "") + member_text(m.name, m.data, mode, depth, budget) if m.data else (m.text or fallback(m.name, m.data))))
    return out


def member_text(name: str, raw: bytes, mode: str, depth: int, budget: containers.Budget | None = None) -> str:
    """Text of a member by extension, else by content, else the fallback."""
    kind = extractor_map().get(extension(name)) or extractor_map().get(_sniff(raw), "")
    if kind and kind not in ("audio", "video", "vsd"):
        try:
            got = read(name, raw, kind, mode, depth=depth + 1, budget=budget)
            if got.status == "success" and got.content:
                return got.content
        except Exception:
            pass
    return fallback(name, raw)


def rendered(rows: list[tuple[str, bool, int, str]]) -> str:
    return "".join(f"=== {name} ===\n{text}\n\n" for name, is_dir, _, text in rows if not is_dir and text)


def _office(name: str, raw: bytes, kind: str, fixed: bool, ocr: bool, depth: int, embed: int, budget: containers.Budget) -> str:
    """Text of an Office file and of what is embedded in it. ``depth`` counts containers of all kinds, ``embed`` Office files in Office files."""
    if depth >= containers.MOST_DEPTH:
        raise ValueError(f"压缩包层级超过最大深度 {containers.MOST_DEPTH}")
    if kind == "pptx" and extension(name) == "vsdx":
        text = office.vsdx(raw, fixed, budget)
    else:
        text = office.READERS[kind](raw, fixed, budget)
    more = []
    if kind != "xlsb" and embed < office.EMBED_DEPTH:
        for base, data in office.embedded(raw, budget):
            inner = extractor_map().get(extension(base), "")
            try:
                if inner in office.READERS:
                    more.append(_office(base, data, inner, fixed, False, depth + 1, embed + 1, budget))
                elif inner == "pdf":
                    more.append(pdf.text(data))
                elif inner == "archive":
                    more.append(rendered(archive_rows("zip", base, data, "fixed" if fixed else "reference", depth + 1, budget.nested())))
            except Exception:
                continue
        if ocr:
            more += [t for _, data in office.media(raw, budget) if (t := media.ocr(data))]
    if kind in ("docx", "pptx") and not fixed:
        text += "".join(x + "\n" for x in more if x)
        return text if kind == "docx" else text.strip()
    return "\n".join(x for x in (text, *more) if x)


def read(name: str, raw: bytes, kind: str, mode: str = "reference", ocr: bool = False, depth: int = 0, budget: containers.Budget | None = None) -> Reading:
    """Text of one file by its extractor's name. Raises for damaged files. ``budget``: what the outermost file may still unpack."""
    fixed = mode == "fixed"
    budget = budget or containers.Budget()
    if kind == "text":
        return Reading(content=T.decode_text(raw, fixed))
    if kind == "csv":
        return Reading(content=T.normalise_csv(raw))
    if kind == "rtf":
        return Reading(content=T.rtf_text(raw, fixed))
    if kind == "pgp":
        if raw[:1] in (b"\x85", b"\xc0", b"\xc3", b"\xc6"):
            raise containers.Encrypted("pgp")
        return Reading(content=T.pgp_text(raw))
    if kind in office.READERS:
        text = _office(name, raw, kind, fixed, ocr, depth, 0, budget)
    elif kind == "archive":
        return Reading(content=rendered(archive_rows(extension(name) if extension(name) in containers.NESTED else (_sniff(raw) or "zip"), name, raw, mode, depth, budget)))
    elif kind == "xls":
        text = legacy.xls(raw, fixed)
    elif kind == "doc":
        text = legacy.doc(raw)
    elif kind == "ppt":
        text = legacy.ppt(raw)
    elif kind == "pdf":
        text = pdf.text(raw)
    elif kind == "image":
        found = media.ocr(raw) if ocr else None
        if ocr and found is None:
            return Reading("skipped", media.image_note(raw, extension(name)).replace("no OCR enabled", "OCR unavailable for this format"), "OCR不支持该图片格式")
        return Reading(content=found if ocr else media.image_note(raw, extension(name)))
    else:
        raise ValueError(kind)
    if not text and kind in NEED_TEXT:
        return Reading("failed", "", NEED_TEXT[kind])
    return Reading(content=text)


def safe_read(name: str, raw: bytes, kind: str, mode: str = "reference", ocr: bool = False) -> Reading:
    """``read``, where every failure is a row: damaged files fail, encrypted ones say so."""
    try:
        return read(name, raw, kind, mode, ocr)
    except containers.Encrypted:
        return Reading("encrypted" if kind in ("pdf", "pgp") else "failed", "", "文件已加密，无法提取内容", True)
    except Exception as e:
        return Reading("failed", "", (f"解压失败: {e}" if kind == "archive" else str(e)) or "读取失败")
