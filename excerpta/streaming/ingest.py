"""Files as a stream: extraction as they arrive, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..plans.extract import extract


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def once_each(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Files whose key (path, time, size, first bytes) was not seen within the allowed lateness; the state is bounded by it."""
    keyed = files.withColumn("key", cache_key(F.col("path"), F.unix_micros("modificationTime") * 1000, F.col("length"), F.lit(False), F.col("content")))
    return keyed.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["key"]).drop("key")


def extract_stream(files: DataFrame, mode: str = "reference") -> DataFrame:
    return extract(files, mode)


#: Paths of new files that are sent to every executor; beyond that the join moves the new files' contents once.
MOST_PATHS = 200_000


def incremental(spark: SparkSession, files: DataFrame, cache: DataFrame | None, mode: str = "reference") -> DataFrame:
    """Results for all files, taking those whose key a cache table (key, result columns) has from there.

    Only paths and keys are joined with the cache; files go on to extraction where their path is among the new ones.
    """
    key = cache_key(F.col("path"), F.unix_micros("modificationTime") * 1000, F.col("length"), F.lit(mode), F.col("content"))
    if cache is None:
        return extract(files, mode)
    keys = files.select("path", key.alias("key"))
    new = keys.join(cache.select("key"), "key", "left_anti").select("path").distinct()
    if new.limit(MOST_PATHS + 1).count() <= MOST_PATHS:
        new = F.broadcast(new)
    old = cache.join(keys.select("key").distinct(), "key", "left_semi").drop("key")
    return old.unionByName(extract(files.join(new, "path", "left_semi"), mode))
