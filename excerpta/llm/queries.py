"""The registered queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, minhash, mixing, multiindex, pii, resampling, simhash, suffixes, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_warc_revisit": warc.query,
        "op2_one_permutation_minhash": lambda s, d: minhash.op2(table(s, d, "documents")),
        "op3_bootstrapped_pii": lambda s, d: pii.op3(table(s, d, "documents")),
        "op4_source_mixing": lambda s, d: mixing.op4(table(s, d, "documents")),
        "op5_suffix_dedup": lambda s, d: suffixes.op5(table(s, d, "documents")),
        "op6_golay_simhash": lambda s, d: simhash.op6(table(s, d, "documents")),
        "op7_inverted_multi_index": lambda s, d: multiindex.op7(table(s, d, "embeddings")),
        "op8_language_id": lambda s, d: langid.op8(table(s, d, "documents")),
        "op9_importance_resampling": lambda s, d: resampling.op9(table(s, d, "documents"), table(s, d, "labels")),
        "op10_byte_bpe": lambda s, d: bpe.op10(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisit": warc.ORACLE_SQL, "op7_inverted_multi_index": multiindex.ORACLE_SQL}
