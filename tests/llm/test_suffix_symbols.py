"""The suffix arrays of op5 get no more symbols than their strings need."""

import numpy as np

from excerpta.llm import suffixes


def test_symbols_of_contexts(monkeypatch):
    """Contexts that share the bytes after their anchor take ten symbols each, and none for the half in which nothing is shared."""
    rng = np.random.default_rng(5)
    ctx = rng.integers(2, 250, (200, 2 * suffixes.SIDE)).astype(np.int16)
    ctx[:, suffixes.SIDE :] = ctx[0, suffixes.SIDE :]
    ctx[100:, 12 : suffixes.SIDE] = ctx[:100, 12 : suffixes.SIDE]  # each of these shares six bytes before the anchor with one of the others
    sizes, real = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda s: sizes.append(len(s)) or real(s))
    doc = np.arange(200)
    got = suffixes._earliest(np.zeros(200, np.int64), ctx, doc)
    for j in range(suffixes.SIDE + 1):
        strings = [tuple(c[j : suffixes.SIDE + j]) for c in ctx]
        assert got[:, j].tolist() == [strings.index(s) for s in strings]
    assert sum(sizes) <= 200 * 10 + 1
