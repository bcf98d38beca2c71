"""Counts of the communication matrix: exact sums at any size, and the law of draws without replacement."""

from math import comb

import numpy as np

from murmuration.llm import sharding


def test_draws_follow_the_hypergeometric_law():
    good, bad, drawn, times = 7, 13, 9, 40_000
    rng = np.random.default_rng(5)
    seen = np.bincount([sharding.hypergeometric(good, bad, drawn, rng) for _ in range(times)], minlength=drawn + 1)
    want = np.array([comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) for k in range(drawn + 1)])
    assert (seen[want == 0] == 0).all()
    assert (abs(seen / times - want) < 5 * np.sqrt(want / times) + 1e-9).all()


def test_edges_of_a_draw():
    rng = np.random.default_rng(1)
    assert sharding.hypergeometric(0, 5, 3, rng) == 0
    assert sharding.hypergeometric(5, 0, 3, rng) == 3
    assert sharding.hypergeometric(4, 6, 10, rng) == 4
    assert sharding.hypergeometric(4, 6, 0, rng) == 0


def test_counts_of_more_rows_than_numpy_draws_from():
    sizes = [3 * 10**9 + 1, 0, 2 * 10**9, 5]
    counts = sharding.communication_matrix(sizes, 24, 29)
    assert counts.sum(axis=1).tolist() == sizes
    shards = counts.sum(axis=0)
    assert shards.sum() == sum(sizes) and shards.max() - shards.min() <= 1
    expected = sizes[0] / 24
    assert (abs(counts[0] - expected) < 6 * (expected * 0.4) ** 0.5).all()
    assert (counts == sharding.communication_matrix(sizes, 24, 29)).all()


def test_both_ways_of_drawing_keep_the_sums(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    counts = sharding.communication_matrix([40, 7, 0, 13], 7, 3)
    assert counts.sum(axis=1).tolist() == [40, 7, 0, 13] and (counts >= 0).all()
    assert counts.sum(axis=0).max() - counts.sum(axis=0).min() <= 1
