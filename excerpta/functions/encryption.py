"""Encryption predicates on the first bytes of a file, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Starts of formats that are not PGP; first bytes that are; second bytes that rule a packet out.
NOT_PGP = (
    "D0CF11E0 504B0304 25504446 377ABCAF 52617221 89504E47 8B4A4E47 8A4D4E47 FFD8FF 474946 424D 49492A00 4D4D002A 52494646 4F676753 664C6143 494433 FFFB FFFA FFF3 1A45DFA3 3026B275 4D5A 7F454C46 CAFEBABE 25215053 8180"
).split()
PGP_FIRST = "85 8C C4 A8 84 8D 95 99".split()
NOT_PACKET_SECOND = "50 4A 4D 47".split()
NOT_PACKET_PAIRS = "8950 8A4D 8B4A 8180 5261 377A".split()
# Compressed streams and the starts by which they are known. Their bytes are as good as random.
STREAMS = {"1F8B08": ("gz", "tgz", "tar.gz"), "425A68": ("bz2", "tar.bz2"), "FD377A585A00": ("xz", "tar.xz")}
OOXML = "docx xlsx pptx docm xlsm pptm xlsb dotx dotm xltx xltm potx potm ppsx ppsm".split()


def _byte(c: Column, at: int) -> Column:
    """Unsigned value of a byte, counted from 0; null beyond the end."""
    return F.conv(F.nullif(F.hex(F.substring(c, at + 1, 1)), F.lit("")), 16, 10).cast("int")


def _starts(c: Column, digits: str) -> Column:
    return F.startswith(c, F.unhex(F.lit(digits)))


def zip_encrypted(c: Column) -> Column:
    """Bit 0 of the flags of the first local header."""
    return F.coalesce(_starts(c, "504B0304") & (F.length(c) >= 8) & (_byte(c, 6).bitwiseAND(F.lit(1)) == 1), F.lit(False))


def pdf_encrypted(c: Column) -> Column:
    head = F.substring(c, 1, 8192)
    return reduce(lambda a, k: a | F.contains(head, F.encode(F.lit(k), "UTF-8")), ("/EncryptMetadata", "/Filter /Standard"), F.contains(head, F.encode(F.lit("/Encrypt"), "UTF-8")))


def rar_encrypted(c: Column) -> Column:
    """Flag of a version 4 archive's file header; version 5 is never told."""
    four = (_byte(c, 7) == 0) & (_byte(c, 6) != 1)
    return F.coalesce((F.length(c) >= 42) & four & _byte(c, 38).isin(1, 2) & (_byte(c, 40).bitwiseAND(F.lit(1)) == 1), F.lit(False))


def pgp_like(c: Column, strict: bool = False) -> Column:
    """The heuristic for PGP data. It also takes UTF-8 text that starts with some letters; ``strict`` asks for armor or a first byte that only packets have."""
    digits = F.hex(F.substring(c, 1, 100))
    armor = F.contains(F.substring(c, 1, 100), F.encode(F.lit("-----BEGIN PGP"), "UTF-8"))
    negative = reduce(lambda a, p: a | F.startswith(digits, F.lit(p)), NOT_PGP[1:], F.startswith(digits, F.lit(NOT_PGP[0])))
    first, second, pair = F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 3, 4)
    if strict:
        return F.coalesce(~negative & (armor | first.isin("84", "85", "8C", "8D", "99")), F.lit(False))
    b = _byte(c, 0)
    tagged = b.bitwiseAND(F.lit(0xC0)).isin(0x80, 0xC0) & b.bitwiseAND(F.lit(0x3F)).between(1, 19)
    excluded = (F.length(c) >= 3) & (second.isin(*NOT_PACKET_SECOND) | pair.isin(*NOT_PACKET_PAIRS))
    named = F.contains(F.substring(c, 1, 100), F.encode(F.lit("PGP"), "UTF-8"))
    return F.coalesce(F.when(negative, False).when(first.isin(*PGP_FIRST), True).when(tagged & ~excluded, True).otherwise(named), F.lit(False))


def compressed_stream(c: Column, ext: Column) -> Column:
    """Whether a file of a compressed type starts as its type does. The letters "PGP" in such a stream are chance, or a text too short to be compressed."""
    return reduce(lambda a, p: a | (ext.isin(*STREAMS[p]) & _starts(c, p)), STREAMS, F.lit(False))


def seven_zip_encrypted(c: Column) -> Column:
    """An encoded end header, or the AES method named in a plain one. The start header gives its place and size in little-endian numbers."""
    number = lambda at: reduce(lambda a, i: a + F.coalesce(_byte(c, at + i), F.lit(0)).cast("long") * F.lit(256**i), range(1, 7), F.coalesce(_byte(c, at), F.lit(0)).cast("long"))
    offset, size = number(12), number(20)
    end = F.substring(c, (offset + 33).cast("int"), F.least(size, F.lit(10000)).cast("int"))
    kind = F.hex(F.substring(end, 1, 1))
    aes = F.contains(end, F.unhex(F.lit("06F10701")))
    fits = (size > 0) & (offset >= 0) & (offset + 32 < F.length(c))
    return F.coalesce(F.when(fits, (kind == "17") | ((kind == "01") & (size < 10000) & aes)).otherwise(False), F.lit(False))


def encrypted(c: Column, ext: Column, ole: Column | None = None, strict_pgp: bool = False) -> Column:
    """Whether a file is encrypted. ``ole``: the verdict on compound files, from ``operators.legacy``; by default that OOXML types in one are.

    Under four bytes nothing is. Formats are tried in order, and the PGP heuristic only where no other matches. Compressed
    streams have no mark of encryption.
    """
    ole = ext.isin(*OOXML) if ole is None else F.coalesce(ole, F.lit(False))
    return (
        F.when(F.coalesce(F.length(c), F.lit(0)) < 4, False)
        .when(_starts(c, "D0CF11E0A1B11AE1"), ole)
        .when(_starts(c, "504B0304"), zip_encrypted(c))
        .when(_starts(c, "25504446"), pdf_encrypted(c))
        .when(_starts(c, "377ABCAF271C"), seven_zip_encrypted(c))
        .when(_starts(c, "526172211A07"), rar_encrypted(c))
        .when(compressed_stream(c, ext), False)
        .otherwise(pgp_like(c, strict_pgp))
    )


def info(path: Column, c: Column, ext: Column, ole: Column | None = None) -> Column:
    """file_path, is_encrypted, encryption_type, header_hex (32 bytes), file_type."""
    kind = F.when(_starts(c, "D0CF11E0A1B11AE1"), "OLE").when(_starts(c, "504B0304"), "ZIP").when(_starts(c, "25504446"), "PDF").when(_starts(c, "377ABCAF271C"), "7Z").when(_starts(c, "526172211A07"), "RAR").when(pgp_like(c), "PGP").otherwise("")
    return F.struct(path.alias("file_path"), encrypted(c, ext, ole).alias("is_encrypted"), kind.alias("encryption_type"), F.hex(F.substring(c, 1, 32)).alias("header_hex"), ext.alias("file_type"))
