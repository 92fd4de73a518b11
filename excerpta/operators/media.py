"""Pictures: their size from the first bytes, and the place where OCR plugs in."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

HEAD = 512


def dimensions(head: bytes | None) -> tuple[int, int] | None:
    """Width and height from the first 512 bytes of PNG, GIF, JPEG, BMP, TIFF, WebP or PSD data."""
    b = (head or b"")[:HEAD]
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", b[16:24])
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", b[6:10])
        if b[:2] == b"BM":
            w, h = struct.unpack("<ii", b[18:26])
            return w, abs(h)
        if b[:4] == b"8BPS":
            h, w = struct.unpack(">II", b[14:22])
            return w, h
        if b[:4] == b"RIFF" and b[8:16] == b"WEBPVP8X":
            return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(b) and b[at] == 0xFF:
                if 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                    return w, h
                at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
        if b[:4] in (b"II*\0", b"MM\0*"):
            e = "<" if b[:1] == b"I" else ">"
            at, found = struct.unpack(e + "I", b[4:8])[0], {}
            for i in range(struct.unpack(e + "H", b[at : at + 2])[0]):
                tag, kind = struct.unpack(e + "HH", b[at + 2 + 12 * i : at + 6 + 12 * i])
                found[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), b[at + 10 + 12 * i : at + 10 + 12 * i + (2 if kind == 3 else 4)])[0]
            return found[256], found[257]
    except (struct.error, KeyError, IndexError):
        pass
    return None


def image_note(raw: bytes | None, ext: str) -> str:
    """What stands for a picture when OCR is off."""
    size = dimensions(raw)
    return f"[image: no OCR enabled, {ext}, {size[0]}x{size[1]}]" if size else "[image: no OCR enabled, dimensions unavailable]"


#: Set on each worker to a function from picture bytes to recognised lines, such as one over an ONNX model.
recognise: Callable[[bytes], list[str]] | None = None


def ocr(raw: bytes) -> str | None:
    """Recognised text, one line a box; None without a model or on failure."""
    if recognise is None:
        return None
    try:
        return "\n".join(line for line in recognise(raw) if re.search(r"\S", line))
    except Exception:
        return None
