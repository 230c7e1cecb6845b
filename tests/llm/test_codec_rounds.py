"""What a step found in the tables is kept for the round's learning, which doesn't look for it again."""

import numpy as np
import pytest

from policyspark.llm import codec


@pytest.mark.parametrize("n", [1, 5000, 3 * 4096 + 77])
def test_contexts_are_looked_up_once(n, monkeypatch):
    calls, real = [], codec._Model.places
    monkeypatch.setattr(codec._Model, "places", lambda self, *a: calls.append(1) or real(self, *a))
    ids = np.random.default_rng(5).zipf(1.3, n).clip(0, 700).astype("<u4")
    blocks = codec.encode_blocks(ids, 4096)
    steps = codec._steps(min(n, 4096))
    assert len(calls) == len(codec._rounds(steps))
    calls.clear()
    assert (np.concatenate(codec.decode_blocks(blocks)) == ids).all()
    assert len(calls) == steps
