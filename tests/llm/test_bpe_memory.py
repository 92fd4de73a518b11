"""A worker that has ended its task holds no codec: an executor has more workers than cores, and each gets tasks in turn."""

import gc

import public_tokenizers as P
import pyarrow as pa

from excerpta.llm import bpe


def test_nothing_stays_after_a_task():
    run = bpe._encode(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, True)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], ["id", "text"])
    once = [b.to_pylist() for b in run(iter([batch]))]
    gc.collect()
    assert not any(isinstance(x, bpe.Codec) for x in gc.get_objects())
    assert bpe.vocabulary.cache_info().currsize == 0
    assert [b.to_pylist() for b in run(iter([batch]))] == once
