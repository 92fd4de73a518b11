"""Archive members as ordered rows, for every container format, under one set of limits.

``members(kind, name, raw)`` yields ``Member`` in container order. Whatever the format, a name that leaves the
archive is dropped, a member or a sum over the limit is skipped, more entries than allowed is an error, and a
damaged tail ends the list instead of failing it.
"""

from __future__ import annotations

import bz2
import datetime
import gzip
import io
import lzma
import posixpath
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

# Limits on a member, on the sum of an archive, on its entries, on nesting.
MOST_MEMBER, MOST_TOTAL, MOST_ENTRIES, MOST_DEPTH = 1 << 30, 5 << 30, 10_000, 10
NESTED = ("zip", "7z", "rar", "tar", "gz", "bz2", "xz", "tgz", "tar.gz", "tar.bz2", "tar.xz", "rpm", "iso")


class Encrypted(Exception):
    """The container asks for a password."""


@dataclass
class Member:
    name: str
    is_dir: bool
    data: bytes | None = None
    text: str | None = None


class Budget:
    """What an archive may still hold: bytes in all, nested archives and Office files included, and entries of its own."""

    def __init__(self, left: int = MOST_TOTAL, entries: int = 0, above: Budget | None = None):
        self._left, self.entries, self.above = left, entries, above

    @property
    def left(self) -> int:
        return self.above.left if self.above else self._left

    @left.setter
    def left(self, value: int) -> None:
        if self.above:
            self.above.left = value
        else:
            self._left = value

    def nested(self) -> Budget:
        """The same bytes for an archive inside, whose entries count on their own."""
        return Budget(above=self)

    def count(self) -> None:
        self.entries += 1
        if self.entries > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} entries")

    def allows(self, size: int) -> bool:
        return size <= min(self.left, MOST_MEMBER)

    def read(self, stream, declared: int | None = None) -> bytes | None:
        """A member's bytes, or None where they are over a limit."""
        if declared is not None and not self.allows(declared):
            return None
        data = stream.read(min(self.left, MOST_MEMBER) + 1)
        if not self.allows(len(data)):
            return None
        self.left -= len(data)
        return data


def safe_name(name: str) -> str | None:
    """Clean relative name, or None where it is empty, absolute, on a drive or outside of the archive."""
    name = name.replace("\\", "/")
    if not name or name.startswith("/") or re.match(r"[A-Za-z]:", name) or "\0" in name:
        return None
    clean = posixpath.normpath(name)
    return None if clean in (".", "..") or clean.startswith("../") else clean


def _zip(name: str, raw: bytes, budget: Budget) -> Iterator[Member]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        if len(infos) > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} entries")
        for i in infos:
            clean = safe_name(i.filename)
            if clean is None:
                continue
            if i.is_dir():
                yield Member(clean, True)
                continue
            try:
                with z.open(i) as f:
                    data = budget.read(f, i.file_size)
            except Exception:  # a bad or locked member is left out, the others stay
                continue
            if data is not None:
                yield Member(clean, False, data)


def _tar(name: str, raw: bytes, budget: Budget, mode: str = "r:") -> Iterator[Member]:
    with tarfile.open(fileobj=io.BytesIO(raw), mode=mode) as t:
        while True:
            try:
                i = t.next()
            except (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError):
                return
            if i is None:
                return
            budget.count()
            clean = safe_name(i.name)
            if clean is None:
                continue
            if i.isdir():
                yield Member(clean, True)
            elif i.isfile():
                try:
                    data = budget.read(t.extractfile(i), i.size)
                except (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError):
                    return
                if data is not None and len(data) == i.size:
                    yield Member(clean, False, data)


def _single(open_, suffix: str):
    def run(name: str, raw: bytes, budget: Budget) -> Iterator[Member]:
        inner = name[: -len(suffix)] if name.lower().endswith(suffix) else name
        with open_(io.BytesIO(raw)) as f:
            data = budget.read(f)
        if data is None:
            return
        note = None if data else f"[{suffix[1:].upper()}文件已解压，大小: 0 字节]"
        yield Member(inner or "content", False, data, note)

    return run


def _number7(f: io.BytesIO) -> int:
    """A 7z number: leading ones of the first byte tell how many bytes follow."""
    first = f.read(1)[0]
    value, mask = 0, 0x80
    for i in range(8):
        if not first & mask:
            return value | (first & (mask - 1)) << 8 * i
        value |= f.read(1)[0] << 8 * i
        mask >>= 1
    return value


def _bits7(f: io.BytesIO, n: int, all_defined: bool = True) -> list[bool]:
    if all_defined and f.read(1)[0]:
        return [True] * n
    raw = f.read((n + 7) // 8)
    return [bool(raw[i // 8] >> (7 - i % 8) & 1) for i in range(n)]


def _streams7(f: io.BytesIO) -> dict:
    out: dict = {"pack_pos": 0, "pack": [], "folders": [], "sizes": [], "per_folder": []}
    while (kind := f.read(1)[0]) != 0:
        if kind == 6:
            out["pack_pos"], n = _number7(f), _number7(f)
            while (k := f.read(1)[0]) != 0:
                if k == 9:
                    out["pack"] = [_number7(f) for _ in range(n)]
                elif k == 10:
                    f.read(4 * sum(_bits7(f, n)))
        elif kind == 7:
            f.read(1)
            n = _number7(f)
            if f.read(1)[0]:
                raise ValueError("external folders")
            for _ in range(n):
                coders = []
                for _ in range(_number7(f)):
                    flags = f.read(1)[0]
                    method = f.read(flags & 15)
                    if flags & 16:
                        f.read(0)
                        if (_number7(f), _number7(f)) != (1, 1):
                            raise ValueError("branched coders")
                    props = f.read(_number7(f)) if flags & 32 else b""
                    coders.append((method, props))
                for _ in range(len(coders) - 1):
                    _number7(f), _number7(f)
                out["folders"].append(coders)
            while (k := f.read(1)[0]) != 0:
                if k == 12:
                    out["unpacked"] = [[_number7(f) for _ in c] for c in out["folders"]]
                elif k == 10:
                    f.read(4 * sum(_bits7(f, n)))
            out["per_folder"] = [1] * n
            out["sizes"] = [u[-1] for u in out.get("unpacked", [])]
        elif kind == 8:
            k = f.read(1)[0]
            if k == 13:
                out["per_folder"] = [_number7(f) for _ in out["folders"]]
                k = f.read(1)[0]
            sizes = []
            for n, total in zip(out["per_folder"], [u[-1] for u in out["unpacked"]]):
                own = [_number7(f) for _ in range(n - 1)] if k == 9 and n else []
                sizes += [*own, total - sum(own)] if n else []
            out["sizes"] = sizes
            if k == 9:
                k = f.read(1)[0]
            while k != 0:
                if k == 10:
                    n = sum(out["per_folder"])
                    f.read(4 * sum(_bits7(f, n)))
                k = f.read(1)[0]
    return out


def _unpack7(coders: list[tuple[bytes, bytes]], sizes: list[int], data: bytes) -> bytes:
    for (method, props), size in zip(coders, sizes):
        if method == b"\x00":
            continue
        if method[:2] == b"\x06\xf1":
            raise Encrypted("7z")
        if method == b"\x03\x01\x01":
            head = props[0]
            spec = {"id": lzma.FILTER_LZMA1, "dict_size": max(4096, struct.unpack("<I", props[1:5])[0]), "lc": head % 9, "lp": head // 9 % 5, "pb": head // 45}
        elif method == b"\x21":
            p = props[0]
            spec = {"id": lzma.FILTER_LZMA2, "dict_size": min((2 | p & 1) << (p // 2 + 11), 1 << 30)}
        else:
            raise ValueError(f"7z method {method.hex()}")
        data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[spec]).decompress(data, size)
    return data


def _seven(name: str, raw: bytes, budget: Budget) -> Iterator[Member]:
    if raw[:6] != b"7z\xbc\xaf\x27\x1c" or len(raw) < 32:
        raise ValueError("not 7z")
    at, size = struct.unpack("<QQ", raw[12:28])
    head = io.BytesIO(raw[32 + at : 32 + at + size])
    if not size:
        return
    kind = head.read(1)[0]
    if kind == 0x17:
        s = _streams7(head)
        begin = 32 + s["pack_pos"]
        head = io.BytesIO(_unpack7(s["folders"][0], s["unpacked"][0], raw[begin : begin + s["pack"][0]]))
        kind = head.read(1)[0]
    if kind != 1:
        raise ValueError("7z header")
    streams, names, empty = None, [], None
    while (k := head.read(1)[0]) != 0:
        if k == 4:
            streams = _streams7(head)
        elif k == 5:
            n = _number7(head)
            while (p := head.read(1)[0]) != 0:
                body = io.BytesIO(head.read(_number7(head)))
                if p == 14:
                    empty = _bits7(body, n, all_defined=False)
                elif p == 17:
                    body.read(1)
                    names = body.read().decode("utf-16-le", "replace").split("\0")[:n]
        else:
            raise ValueError("7z section")
    data: list[bytes] = []
    if streams:
        begin, sizes = 32 + streams["pack_pos"], iter(streams["sizes"])
        for coders, unpacked, packed, n in zip(streams["folders"], streams["unpacked"], streams["pack"], streams["per_folder"]):
            if not budget.allows(unpacked[-1]):
                data += [None] * n  # type: ignore[list-item]
            else:
                folder, at = _unpack7(coders, unpacked, raw[begin : begin + packed]), 0
                for _ in range(n):
                    own = next(sizes)
                    data.append(folder[at : at + own])
                    at += own
            begin += packed
    filled = iter(data)
    for i, n in enumerate(names):
        budget.count()
        blank = bool(empty and empty[i])
        content = b"" if blank else next(filled, None)
        if (clean := safe_name(n)) and content is not None and budget.allows(len(content)):
            budget.left -= len(content)
            yield Member(clean, False, content)


def _rar(name: str, raw: bytes, budget: Budget) -> Iterator[Member]:
    """Stored members of version 4 archives; others by name only."""
    if raw.startswith(b"Rar!\x1a\x07\x01\x00"):
        yield Member(name, False, None, f"[RAR5: {len(raw)} 字节]")
        return
    if not raw.startswith(b"Rar!\x1a\x07\x00"):
        raise ValueError("not RAR")
    at = 7
    while at + 7 <= len(raw):
        _, kind, flags, size = struct.unpack("<HBHH", raw[at : at + 7])
        if size < 7:
            return
        extra = struct.unpack("<I", raw[at + 7 : at + 11])[0] if flags & 0x8000 or kind == 0x74 else 0
        if kind == 0x73 and flags & 0x80:
            raise Encrypted("rar")
        if kind == 0x74:
            budget.count()
            if flags & 4:
                raise Encrypted("rar")
            packed, unpacked, _, _, _, _, method, n = struct.unpack("<IIBIIBBH", raw[at + 7 : at + 28])
            clean = safe_name(raw[at + 32 : at + 32 + n].split(b"\0")[0].decode("utf-8", "replace"))
            if clean and flags & 0xE0 == 0xE0:
                yield Member(clean, True)
            elif clean and method == 0x30 and budget.allows(unpacked):
                budget.left -= unpacked
                yield Member(clean, False, raw[at + size : at + size + packed])
            elif clean:
                yield Member(clean, False, None, f"[文件: {clean}, 大小: {unpacked} 字节 (二进制或非文本文件)]")
        if kind == 0x7B:
            return
        at += size + extra


# Tags of a package's main header, and the lines that tell of it.
_RPM = {1000: "name", 1001: "version", 1002: "release", 1004: "summary", 1005: "description", 1006: "built", 1009: "size", 1011: "vendor", 1014: "license", 1020: "url", 1022: "architecture", 1047: "provides", 1049: "requires", 1048: "requires_flags", 1050: "requires_version", 1112: "provides_flags", 1113: "provides_version"}
_RPM_LINES = (("摘要", "summary", True), ("描述", "description", False), ("许可证", "license", False), ("厂商", "vendor", False), ("URL", "url", False))
_RPM_SENSE = {2: "<", 4: ">", 8: "=", 10: "<=", 12: ">="}


def rpm_metadata(raw: bytes) -> dict[str, list]:
    """Values of a package's main header by name."""
    if raw[:4] != b"\xed\xab\xee\xdb":
        raise ValueError("not RPM")
    at, out = 96, {}
    for which in range(2):
        if raw[at : at + 3] != b"\x8e\xad\xe8":
            raise ValueError("RPM header")
        n, size = struct.unpack(">II", raw[at + 8 : at + 16])
        store = at + 16 + 16 * n
        if which:
            for i in range(n):
                tag, kind, offset, count = struct.unpack(">IIII", raw[at + 16 + 16 * i : at + 32 + 16 * i])
                if tag in _RPM:
                    body = raw[store + offset :]
                    if kind == 4:
                        out[_RPM[tag]] = list(struct.unpack(f">{count}I", body[: 4 * count]))
                    else:
                        out[_RPM[tag]] = [x.decode("utf-8", "replace") for x in body.split(b"\0", count)[: count if kind in (8, 9) else 1]]
        at = store + size
        if not which:
            at += -at % 8
    return out


def _rpm(name: str, raw: bytes, budget: Budget) -> Iterator[Member]:
    """One row that tells of the package; its payload stays closed."""
    found = rpm_metadata(raw)
    first = lambda k: found.get(k, [""])[0]
    lines = ["[RPM包信息]", f"名称: {first('name')}", f"版本: {first('version')}-{first('release')}", f"架构: {first('architecture')}"]
    lines += [f"{label}: {first(k)}" for label, k, always in _RPM_LINES if always or first(k)]
    built = datetime.datetime.fromtimestamp(first("built") or 0, datetime.timezone.utc)
    lines += [f"构建时间: {built:%Y-%m-%d %H:%M:%S} +0000 UTC", f"大小: {first('size') or 0} 字节"]
    for label, k in (("提供", "provides"), ("依赖", "requires")):
        if found.get(k):
            lines += ["", f"{label}:"]
            for i, own in enumerate(found[k]):
                sense = _RPM_SENSE.get((found.get(f"{k}_flags", []) + [0] * (i + 1))[i] & 14, "")
                version = (found.get(f"{k}_version", []) + [""] * (i + 1))[i]
                lines.append("  - " + " ".join(x for x in (own, sense, version) if x))
    yield Member(name, False, None, "\n".join(lines) + "\n")


def _iso(name: str, raw: bytes, budget: Budget) -> Iterator[Member]:
    block = 2048
    volume = raw[16 * block : 17 * block]
    if volume[1:6] != b"CD001":
        yield Member(name, False, None, f"[ISO镜像信息]\n警告: ISO文件格式不正确: no volume descriptor\n文件大小: {len(raw)} 字节\n")
        return
    label = volume[40:72].decode("ascii", "replace").strip(" \0")
    info = f"[ISO镜像信息]\n卷标识: {label}\n"
    seen: set[int] = set()

    def walk(at: int, size: int, top: str) -> Iterator[Member]:
        if at in seen:
            return
        seen.add(at)
        body, i = raw[at * block : at * block + size], 0
        while i < len(body):
            n = body[i]
            if not n:
                i = (i // block + 1) * block
                continue
            where, length = struct.unpack("<I", body[i + 2 : i + 6])[0], struct.unpack("<I", body[i + 10 : i + 14])[0]
            flags, own = body[i + 25], body[i + 33 : i + 33 + body[i + 32]]
            i += n
            if own in (b"\0", b"\1"):
                continue
            budget.count()
            path = safe_name(top + own.decode("latin-1").split(";")[0])
            if path is None:
                continue
            if flags & 2:
                yield Member(path, True)
                yield from walk(where, length, path + "/")
            elif budget.allows(length):
                budget.left -= length
                yield Member(path, False, raw[where * block : where * block + length], info + "\n\n")

    found = False
    for m in walk(struct.unpack("<I", volume[158:162])[0], struct.unpack("<I", volume[166:170])[0], ""):
        found = True
        yield m
    if not found:
        yield Member(name, False, None, info)


_READERS = {
    "zip": _zip, "tar": _tar, "7z": _seven, "rar": _rar, "rpm": _rpm, "iso": _iso,
    "gz": _single(gzip.open, ".gz"), "bz2": _single(bz2.open, ".bz2"), "xz": _single(lzma.open, ".xz"),
    "tgz": lambda n, r, b: _tar(n, r, b, "r:gz"), "tar.gz": lambda n, r, b: _tar(n, r, b, "r:gz"), "tar.bz2": lambda n, r, b: _tar(n, r, b, "r:bz2"), "tar.xz": lambda n, r, b: _tar(n, r, b, "r:xz"),
}


def members(kind: str, name: str, raw: bytes, budget: Budget | None = None) -> Iterator[Member]:
    """Members of a container in order."""
    return _READERS[kind](name, raw, budget or Budget())
