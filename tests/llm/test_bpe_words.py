"""Byte-level BPE of words of any length against the library."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from excerpta.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe._codec(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def lib(codec):
    return tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=codec.ranks, special_tokens={})


def agree(codec, lib, words):
    got = codec.ids_of([w.encode() for w in words])
    assert [x.tolist() for x in got] == [lib.encode_ordinary(w) for w in words]
    assert codec.decode(got) == [w.encode() for w in words]


def letters(seed, alphabet, n):
    return "".join(np.random.default_rng(seed).choice(list(alphabet), n))


def test_many_ideographs(codec, lib):
    alphabet = [chr(0x4E00 + i) for i in range(8000)]
    agree(codec, lib, [letters(i, alphabet, 100) for i in range(20_000)])


def test_unbroken_letters(codec, lib):
    agree(codec, lib, [letters(1, "abcdefghijklmnopqrstuvwxyz", 20_000), *[letters(i, "abcdefghijklmnopqrstuvwxyz", 500) for i in range(5_000)]])


@pytest.mark.parametrize("unit", ["x", "ab", "abc", "haha", "-", "=-", "中", "中文", "aaab", "0123456789", " ", "😀", "é"])
def test_periodic(codec, lib, unit):
    agree(codec, lib, [unit * n for n in (17, 64, 333, 1000)] + ["q" + unit * 777 + "z"])


def test_a_million_signs(codec, lib):
    agree(codec, lib, ["x" * 1_000_000 + "y", "ha" * 500_000])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aab \ntheéü中😀-=_09'"), min_size=1, max_size=400), min_size=1, max_size=5))
def test_any_word(codec, lib, words):
    agree(codec, lib, words)


def test_long_words_in_a_table(spark):
    texts = [",".join(letters(i, [chr(0x4E00 + k) for k in range(3000)], 100) for _ in range(20)).replace(",", "，") for i in range(300)]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "x" * 3_000_000)]
    got = bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: r for r in got}
    assert all(by_id[i]["ids"] == lib.encode_ordinary(t) and bytes(by_id[i]["decoded"]).decode() == t for i, t in rows)
