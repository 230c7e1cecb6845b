"""Scores of a whole packing shard at once equal those of one seed after another."""

import numpy as np
import pytest

from policyspark.llm import packing


@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_scores_at_once(monkeypatch, pairs):
    monkeypatch.setattr(packing, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.5, rng.integers(1, 80)).clip(0, 900).astype("<u4") for _ in range(90)] + [np.array([5000], "<u4")]
    index = packing.InvertedIndex(docs)
    at_once = [index.scores(i) for i in range(len(docs))]
    assert index.every.shape == (91, 91) and (index.row < 0).any() and len(index.rows)
    monkeypatch.setattr(packing, "WHOLE", 0)
    for i, found in enumerate(at_once):
        others = np.arange(len(docs)) != i
        np.testing.assert_allclose(found[others], index.scores(i)[others], rtol=1e-5, atol=1e-6)


def test_shard_without_rare_terms():
    docs = [np.array([3, 4], "<u4"), np.array([3, 4], "<u4")]
    assert packing.pack_shard(docs, 4) == [[(0, 0, 2), (1, 0, 2)]]
