"""Extraction as a query: files in, one result row each out, in a single scan and without a shuffle.

Detection, routing, encryption flags, plain UTF-8 text, metadata and media rows are Catalyst expressions. Only
rows whose format needs a parser send their bytes to Python, in small Arrow batches; the others pass through
with no bytes attached. A row never fails the query.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect, encryption, text, types
from ..operators import legacy, reader

RESULT = "file_name string, file_type string, file_size bigint, status string, content string, error_msg string, is_encrypt int, execute_time string, skipped boolean"
UNSUPPORTED, ENCRYPTED = "文件类型不支持", "文件已加密，无法提取内容"
METADATA_NOTE = "此文件类型已识别但无内容提取器，仅返回元数据"
VSD_NOTE = "不支持的文件类型: vsd"
OUT_CHARS = 16_000_000
_KEPT = ("file_name", "file_type", "file_size", "status", "content", "error_msg", "is_encrypt", "skipped")
_OUT = pa.schema([("file_name", pa.string()), ("file_type", pa.string()), ("file_size", pa.int64()), ("status", pa.string()), ("content", pa.string()), ("error_msg", pa.string()), ("is_encrypt", pa.int32()), ("execute_time", pa.string()), ("skipped", pa.bool_())])


def planned(files: DataFrame, mode: str = "reference", strict_pgp: bool = False, model: Column | None = None) -> DataFrame:
    """Everything about a file that needs no parser, and ``parser`` with ``bytes`` where one is needed.

    ``files``: path, modificationTime, length, content (the columns of ``binaryFile``). Nulls count as empty.
    """
    path, content = F.coalesce("path", F.lit("")), F.coalesce("content", F.lit(b""))
    routed = detect.routed_type(path, model=model)
    base = files.select(path.alias("path"), "modificationTime", F.coalesce("length", F.length("content"), F.lit(0)).cast("bigint").alias("file_size"), content.alias("content"), detect.base_name(path).alias("file_name"), detect.detected_type(path, model).alias("ext"), routed.alias("routed"))
    base = base.withColumn("file_type", types.mime_of(F.col("ext"))).withColumn("extractor", F.when(F.col("routed").isNotNull(), types.extractor_of(F.col("routed"))))
    ole = F.startswith("content", F.lit(legacy.SIGNATURE))
    flag = encryption.encrypted(F.col("content"), F.col("ext"), F.lit(None).cast("boolean"), strict_pgp)
    valid = detect.valid_path(F.col("path"))
    meta, refused = F.col("extractor") == types.METADATA_ONLY, F.col("flag")
    utf8 = (F.col("extractor") == "text") & text.valid_utf8(F.col("content"))
    base = base.withColumn("flag", flag)
    parser = F.when(~valid | F.col("routed").isNull() | meta | refused | F.col("extractor").isin("audio", "video", "vsd") | utf8, None).otherwise(F.col("extractor"))
    status = F.when(~valid | F.col("routed").isNull(), "failed").when(meta, "skipped").when(refused, "failed").when(F.col("extractor").isin("audio", "video", "vsd"), "skipped").otherwise("success")
    body = F.when(meta & valid, text.metadata_block(F.col("file_name"), F.col("file_type"), F.col("file_size"), F.col("modificationTime"), F.col("content"))).when((status == "success") & utf8, F.col("content").cast("string")).otherwise("")
    error = F.when(~valid, "invalid path").when(F.col("routed").isNull(), UNSUPPORTED).when(meta, METADATA_NOTE).when(refused, ENCRYPTED).when(F.col("extractor") == "vsd", VSD_NOTE).otherwise("")
    skipped = F.when(F.col("extractor").isin("audio", "video") & (status == "skipped"), True)
    return base.select("file_name", "file_type", "file_size", status.alias("status"), body.alias("content"), error.alias("error_msg"), F.col("flag").cast("int").alias("is_encrypt"), skipped.alias("skipped"), "ext", F.coalesce(parser, F.when(ole & valid & ~meta, F.lit(""))).alias("parser"), F.when(parser.isNotNull() | ole, F.col("content")).alias("bytes"))


def sliced(rows: Iterable[dict], text_key: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches whose texts have about ``OUT_CHARS`` characters at most, or one row: an Arrow string column can't hold more than 2 GiB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[text_key] or "")
        if size >= OUT_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _parse(mode: str, ocr: bool):
    def one(r: dict) -> dict:
        began, raw, kind = time.perf_counter(), r["bytes"] or b"", r["parser"]
        if raw.startswith(legacy.SIGNATURE) and legacy.ole_encrypted(raw, r["ext"], mode):
            r |= {"status": "failed", "content": "", "error_msg": ENCRYPTED, "is_encrypt": 1}
        elif kind:
            got = reader.safe_read(r["file_name"], raw, kind, mode, ocr)
            r |= {"status": got.status, "content": got.content, "error_msg": got.error, "is_encrypt": int(got.encrypted or r["is_encrypt"] or 0)}
        return {k: r[k] for k in _KEPT} | {"execute_time": f"{time.perf_counter() - began:.4f}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = pc.is_valid(b.column("parser"))
            ready = b.filter(pc.invert(wanted))
            if ready.num_rows:  # columns pass as they came
                columns = {k: ready.column(k) for k in _KEPT} | {"execute_time": pa.array(["0.0000"] * ready.num_rows)}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in _OUT], schema=_OUT)
            if ready.num_rows < b.num_rows:
                need = b.filter(wanted)
                raw, short = need.column("bytes"), need.drop_columns(["bytes"]).to_pylist()
                yield from sliced((one(r | {"bytes": raw[i].as_py()}) for i, r in enumerate(short)), "content", _OUT)

    return run


def extract(files: DataFrame, mode: str = "reference", ocr: bool = False, strict_pgp: bool = False, model: Column | None = None) -> DataFrame:
    """One result row per file.

    ``mode``: ``reference`` keeps the narrow rules of the published outputs, ``fixed`` corrects them.
    Rows carry whole files, so set ``spark.sql.execution.arrow.maxRecordsPerBatch`` low where files are large.
    """
    return planned(files, mode, strict_pgp, model).mapInArrow(_parse(mode, ocr), RESULT)


def members(files: DataFrame, mode: str = "reference") -> DataFrame:
    """Archive members as rows: ``path, pos, depth, member_path, is_dir, text``; damaged archives have none."""

    schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("depth", pa.int32()), ("member_path", pa.string()), ("is_dir", pa.bool_()), ("text", pa.string())])

    def rows_of(path: str, raw: bytes) -> list[dict]:
        try:
            found = reader.archive_rows(reader.extension(path), path, raw, mode)
        except Exception:
            return []
        return [{"path": path, "pos": i, "depth": d, "member_path": n, "is_dir": x, "text": t} for i, (n, x, d, t) in enumerate(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from sliced((r for path, raw in zip(b.column(0), b.column(1)) for r in rows_of(path.as_py(), raw.as_py())), "text", schema)

    archives = files.filter(types.extractor_of(detect.extension(F.col("path"))) == "archive").filter("content is not null")
    return archives.select("path", "content").mapInArrow(run, "path string, pos int, depth int, member_path string, is_dir boolean, text string")


def pdf_pages(files: DataFrame, page_spec: str | None = None) -> DataFrame:
    """``path, page, text`` of PDF files; a page range as in ``functions.text.page_range``."""
    from ..operators import pdf

    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string())])

    def rows_of(path: str, raw: bytes, wanted: list[int] | None) -> list[dict]:
        try:
            return [{"path": path, "page": p, "text": t} for p, t in pdf.pages(raw, wanted)]
        except Exception:
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from sliced((r for cells in zip(*b.columns) for r in rows_of(*(c.as_py() for c in cells))), "text", schema)

    counted = files.filter("content is not null")
    if page_spec is None:
        rows = counted.select("path", "content", F.lit(None).cast("array<int>").alias("wanted"))
    else:
        from ..functions.udfs import scalar
        from ..operators.pdf import page_count

        n = scalar(lambda raw: [page_count(raw)], "array<int>")
        rows = counted.withColumn("n", F.get(n(F.col("content")), F.lit(0))).select("path", "content", text.page_range(F.lit(page_spec), F.col("n")).alias("wanted"))
        rows = rows.filter("wanted is not null")
    return rows.mapInArrow(run, "path string, page int, text string")


def json_of() -> Column:
    """A result row as JSON with the library's keys; ``skipped`` only where it is set."""
    return F.to_json(F.struct("file_name", "file_type", "file_size", "status", "content", "error_msg", "is_encrypt", "execute_time", "skipped"))


def to_json(results: DataFrame) -> DataFrame:
    """Result rows as ``json``."""
    return results.select(json_of().alias("json"))


def to_json_six(results: DataFrame) -> DataFrame:
    """The six-field form; failures carry only status and message."""
    ok = F.col("status") != "failed"
    return results.select(F.to_json(F.struct(F.when(ok, F.col("file_name")).alias("file_name"), F.when(ok, F.col("file_type")).alias("file_type"), F.when(ok, F.col("file_size")).alias("file_size"), "status", "content", F.col("error_msg").alias("error_message"))).alias("json"))
