"""Helpers shared by the training-data operators: table access, lineage cuts, word rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: the ASCII blanks that ``bytes.split()`` knows.
SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether an execution's shuffle files are deleted as soon as it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder in local mode (tests, a laptop), else a folder of the warehouse,
    which executors share as well.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = sc.getConf().get("spark.checkpoint.dir", "")
        if not own:
            local = sc.master == "local" or sc.master.startswith("local[")
            own = tempfile.mkdtemp(prefix="excerpta-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there from now on.

    The files are replicated like any file of that store, so a lost executor costs nothing but the tasks it was
    running. The shuffles that made them go at once instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)


def dropped(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` made and that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives the memory that it has freed back to the system.

    Workers stay alive for later tasks, beside the heap of an executor that is working on something else by then.
    """

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


#: Size up to which a table of keys is sent to every executor instead of moving the texts to it.
BROADCAST_BYTES = 16_000_000


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows are counted and found to be few enough; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def fresh(base: str = "x") -> str:
    """A column name that no input table has."""
    return f"__{base}_{uuid.uuid4().hex[:8]}"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside one expression: lambda variables are evaluated once, inlined columns are not."""
    return F.transform(F.array(value), body)[0]


def parallelism(df: DataFrame) -> int:
    """Number of shuffle partitions of the session, the unit in which blocks are counted."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
