"""Arrow functions: one Python call for each value, batches moved by Arrow. A failure is a null, never an error."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType

from . import text


def scalar(f: Callable, returns: str) -> Callable[[Column], Column]:
    """An Arrow UDF from a function of one value."""
    kind, spark_type = {"string": (pa.string(), StringType()), "binary": (pa.binary(), BinaryType()), "array<int>": (pa.list_(pa.int32()), ArrayType(IntegerType()))}[returns]

    @arrow_udf(spark_type)
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(f(v))
            except Exception:
                out.append(None)
        return pa.array(out, kind)

    return run


decode_text = scalar(text.decode_text, "string")
decode_text_fixed = scalar(lambda raw: text.decode_text(raw, fixed=True), "string")
normalise_csv = scalar(text.normalise_csv, "string")
unescape = scalar(text.unescape, "string")
rtf_text = scalar(text.rtf_text, "string")
rtf_text_fixed = scalar(lambda raw: text.rtf_text(raw, fixed=True), "string")
utf16_units = scalar(lambda raw: text.utf16_units(raw or b""), "string")
