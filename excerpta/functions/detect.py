"""Type detection and routing as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import types as T

# Magic bytes and the type each one names, in order.
MAGIC = (("D0CF11E0A1B11AE1", "doc"), ("504B0304", "zip"), ("526172211A070100", "rar"), ("526172211A0700", "rar"), ("377ABCAF271C", "7z"), ("25504446", "pdf"), ("85", "pgp"), ("8C", "pgp"), ("C4", "pgp"))
# For an expected type, the detected ones that pass for it. Other types pass only for themselves.
PASSES_FOR = """
doc: doc dot wps wpt
docx: docx dotx dotm docm odt
xls: xls xlt et ett xlsb
xlsx: xlsx xlsm xltx xltm xlam
ppt: ppt pot pps dps dpt
pptx: pptx potx potm ppsm pptm ppsx vsdx
txt: text txt plain log csv ini
log: text txt plain log
ini: text txt plain ini
tgz: tgz tar.gz
jpg: jpg jpeg
"""
# What an error message starts with.
ERROR_STARTS = {"doc": "打开Word文档失败", "docx": "打开Word文档失败", "xls": "打开Excel文件失败", "xlsx": "打开Excel文件失败", "ppt": "打开PowerPoint文件失败", "pptx": "打开PowerPoint文件失败", "pdf": "打开PDF文件失败"}


def base_name(path: Column) -> Column:
    """What follows the last slash of a path or URI."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, double ones of compressed tars first; none: empty."""
    name = F.lower(base_name(path))
    return F.when(name.rlike(r"\.tar\.(gz|xz|bz2)$"), F.regexp_extract(name, r"\.(tar\.(?:gz|xz|bz2))$", 1)).otherwise(F.regexp_extract(name, r"\.([^.]*)$", 1))


def detected_type(path: Column, model: Column | None = None) -> Column:
    """Type of a file: by extension for office, video and audio, else by model if it names a supported type, else by extension."""
    ext = extension(path)
    if model is None:
        return ext
    return F.when(ext.isin(*T.OFFICE, *T.VIDEO, *T.AUDIO), ext).when(T.is_supported(model), model).otherwise(ext)


def simple_type(path: Column, model: Column | None = None) -> Column:
    return extension(path) if model is None else F.coalesce(F.nullif(model, F.lit("unknown")), extension(path))


def routed_type(path: Column, mime: Column | None = None, model: Column | None = None) -> Column:
    """Type that decides the extractor: detected, else implied by MIME type, else metadata only if recognised, else null (unsupported)."""
    found = detected_type(path, model)
    mime = T.mime_of(found) if mime is None else mime
    implied = T.extension_of_mime(mime)
    odt = mime == T.mime_map()["odt"]
    return F.when(T.is_supported(found), found).when(T.is_supported(implied), implied).when(odt, F.lit("odt")).when((mime != T.DEFAULT_MIME) | T.is_recognized(found), F.lit(T.METADATA_ONLY))


def sniffed(content: Column) -> Column:
    """Type by magic bytes at the start of the content; none: empty."""
    first, *rest = MAGIC
    test = lambda m: F.startswith(content, F.unhex(F.lit(m)))
    return reduce(lambda c, m: c.when(test(m[0]), m[1]), rest, F.when(test(first[0]), first[1])).otherwise("")


def printable(content: Column) -> Column:
    """At least 8 of 10 of the first 1000 bytes are printable ASCII or line ends and tabs; empty: no."""
    head = F.decode(F.substring(content, 1, 1000), "ISO-8859-1")
    good = F.length(F.regexp_replace(head, r"[^\x20-\x7e\n\r\t]", ""))
    return (F.length(head) > 0) & (good * 10 >= F.length(head) * 8)


def sniffed_member(content: Column) -> Column:
    """Type of an archive member without extension; under ten bytes: empty."""
    starts = lambda m: F.startswith(content, F.unhex(F.lit(m)))
    return (
        F.when(F.length(content) < 10, "")
        .when(F.substring(content, 258, 5) == F.unhex(F.lit("7573746172")), "tar")
        .when(starts("504B0304"), "zip")
        .when(starts("25504446"), "pdf")
        .when(starts("D0CF11E0A1B11AE1"), "doc")
        .when(starts("377ABCAF271C"), "7z")
        .when(starts("52617221"), "rar")
        .when(printable(content), "txt")
        .otherwise("")
    )


def same_type(expected: Column, found: Column) -> Column:
    """Equal, or a type that passes for the expected one."""
    groups = [line.split(": ") for line in PASSES_FOR.strip().splitlines()]
    return reduce(lambda c, g: c | ((expected == g[0]) & found.isin(*g[1].split())), groups, expected == found)


def error_message(type_: Column, error: Column) -> Column:
    """An error with the words for the kind of file that it concerns."""
    start = reduce(lambda c, e: c.when(type_ == e[0], e[1]), list(ERROR_STARTS.items())[1:], F.when(type_ == "doc", ERROR_STARTS["doc"])).otherwise("打开文件失败")
    return F.concat_ws(": ", start, error)


def valid_path(path: Column) -> Column:
    """Not empty, no NUL, no path that starts by leaving its folder."""
    return F.coalesce((F.length(path) > 0) & ~F.contains(path, F.chr(F.lit(0))) & ~path.rlike(r"^\.\.(/|\\|$)"), F.lit(False))


def is_office(path: Column) -> Column:
    return T.category_of(extension(path)) == "office"


def is_archive(path: Column) -> Column:
    return T.category_of(extension(path)) == "archive"


def is_image(path: Column) -> Column:
    return T.category_of(extension(path)) == "image"


def is_text(path: Column) -> Column:
    return T.category_of(extension(path)) == "text"
