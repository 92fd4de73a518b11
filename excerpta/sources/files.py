"""Sources and sinks: whole files, first bytes of files, JSON and text output, SQL registration, the command line."""

from __future__ import annotations

import argparse
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans import extract as X

VERSION = "0.2.0"


def read_files(spark: SparkSession, path: str, most_bytes: int | None = None, glob: str | None = None) -> DataFrame:
    """Whole files; the size bound is pushed into the scan, so larger files are never opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df if most_bytes is None else df.filter(F.col("length") <= most_bytes)


class FileHead(DataSource):
    """``filehead``: path, length and the first bytes of the files in a local or mounted folder, without reading the rest."""

    @classmethod
    def name(cls) -> str:
        return "filehead"

    def schema(self) -> str:
        return "path string, length bigint, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(self.options)


class _HeadReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.bytes, self.slices = options["path"], int(options.get("bytes", 8192)), int(options.get("partitions", 16))

    def partitions(self):
        """The folder is listed once; each partition gets its share of the names."""
        import os

        found = sorted(os.path.join(folder, n) for folder, _, names in os.walk(self.root) for n in names)
        return [InputPartition(found[i :: self.slices]) for i in range(min(self.slices, max(1, len(found))))]

    def read(self, partition):
        import os

        for p in partition.value:
            with open(p, "rb") as f:
                yield p, os.path.getsize(p), f.read(self.bytes)


def register(spark: SparkSession) -> None:
    """``filehead`` as a source, and ``extract_file(path, content)`` as a SQL function that returns the JSON result."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    from ..functions.types import extractor_map
    from ..operators import reader

    def extract_file(paths, contents):
        out = []
        for p, c in zip(paths.to_pylist(), contents.to_pylist()):
            kind = extractor_map().get(reader.extension(p or ""))
            got = reader.safe_read(p, c or b"", kind) if p and kind and kind not in ("audio", "video", "vsd") else reader.Reading("skipped" if kind else "failed", "", "" if kind else X.UNSUPPORTED)
            out.append({"status": got.status, "content": got.content, "error_msg": got.error, "is_encrypt": int(got.encrypted)})
        return pa.array(out, pa.struct([("status", pa.string()), ("content", pa.string()), ("error_msg", pa.string()), ("is_encrypt", pa.int32())]))

    spark.dataSource.register(FileHead)
    extract_file.__annotations__ = {"paths": pa.Array, "contents": pa.Array, "return": pa.Array}
    spark.udf.register("extract_file", arrow_udf(extract_file, "struct<status:string,content:string,error_msg:string,is_encrypt:int>"))


def write_json(results: DataFrame, path: str) -> None:
    X.to_json(results).withColumnRenamed("json", "value").write.mode("overwrite").text(path)


def write_texts(results: DataFrame, path: str) -> None:
    """Contents that are not empty, one folder a file name, as text."""
    results.filter("content <> ''").select(F.concat("file_name", F.lit(".txt")).alias("file"), F.col("content").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def main(args: list[str] | None = None) -> None:
    """``python -m excerpta.sources.files [--ocr] [--mode MODE] [--output FOLDER] PATH | version``: results as JSON lines, texts as ``FOLDER/NAME.txt``."""
    p = argparse.ArgumentParser(prog="excerpta")
    p.add_argument("path", help="a file or folder, or the word version")
    p.add_argument("--ocr", action="store_true")
    p.add_argument("--mode", choices=("reference", "fixed"), default="reference")
    p.add_argument("--output", help="folder for the texts")
    a = p.parse_args(args)
    if a.path == "version":
        print(f"excerpta {VERSION}")
        return
    from ..session import ship

    spark = ship(SparkSession.builder.appName("excerpta").getOrCreate())
    results = X.extract(read_files(spark, str(PurePosixPath(a.path))), a.mode, a.ocr)
    for row in results.withColumn("json", X.json_of()).select("json", "file_name", "content").toLocalIterator():
        print(row["json"])
        if a.output and row["content"]:
            (Path(a.output) / f"{row['file_name']}.txt").write_text(row["content"], encoding="utf-8")


if __name__ == "__main__":
    main()
