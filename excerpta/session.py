"""Session helpers: executors get this package with the job, so no worker needs an installed copy."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between the JVM and a Python worker. Rows carry whole texts and files, so the number of rows bounds nothing.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add this package to the Python path of every executor, once per application, and bound Arrow batches unless the session does."""
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="excerpta-ship-")) / "excerpta_package.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(Path(top.name) / p.relative_to(top)))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark
