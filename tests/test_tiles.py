"""Tiles of pairs of texts: each pair is compared once, and the work isn't put into a few tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.operators import similarity


def plain(a, b):
    a, b = ({t[i : i + 2] for i in range(len(t) - 1)} or set(t) for t in (a, b))
    return len(a & b) / len(a | b) if a and b else 0.0


def test_two_blocks_are_compared_once_and_tiles_keep_their_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 64)
    df = spark.range(1000).select(F.lit("hot").alias("grp"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    real, pairs, tasks = similarity._tile, spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def tile(batch):
        from pyspark import TaskContext

        rows = sum(1 for side in batch.column("side").to_pylist() if side == 0)
        pairs.add(rows * (batch.num_rows - rows))
        tasks.add(1 << (8 * TaskContext.get().partitionId()))
        return real(batch)

    monkeypatch.setattr(similarity, "_tile", tile)
    similarity.average_likeness(df).collect()
    assert pairs.value < 0.6 * 1000 * 1000
    assert len([b for b in tasks.value.to_bytes(64, "big") if b]) == 4


@pytest.mark.parametrize("gain", [0, 1, 128, 10**9])
def test_inverted_lists_and_bits_count_the_same(monkeypatch, gain):
    monkeypatch.setattr(similarity, "BIT_GAIN", gain)
    monkeypatch.setattr(similarity, "STRIP", 50)
    rng = random.Random(4)
    a, b = (["".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.choice([0, 1, 2, 30, 600]))) for _ in range(n)] for n in (23, 31))
    weights = np.array([rng.randint(1, 4) for _ in b], float)
    assert similarity.likeness_to_all(a, b, weights) == pytest.approx([sum(w * plain(x, y) for y, w in zip(b, weights)) for x in a], abs=1e-12)
    assert similarity.paired_likeness(a, b[:23]) == pytest.approx([plain(x, y) for x, y in zip(a, b)], abs=1e-12)
    assert len(similarity.likeness_to_all([], b, weights)) == 0 and len(similarity.paired_likeness([], [])) == 0
