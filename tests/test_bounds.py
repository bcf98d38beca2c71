"""A bound of a large group's likeness: never under the mean, tight enough to settle unlike texts, and the swarms are the same with it."""

import random

import pytest
from pyspark.sql import functions as F

from murmuration.operators import similarity, swarms
from murmuration.sources.kept import kept

HEX = "0123456789abcdef"


def texts_of(rng):
    words = ["harbour", "photo", "wonderful", "出会い", "🎉🎉", "old", "a", "the light"]
    return {
        "hex": ["".join(rng.choice(HEX) for _ in range(32)) for _ in range(300)],
        "alike": [f"what a wonderful photo of the old harbour {i}" for i in range(200)],
        "mixed": [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(200)] + ["", "x", "x" * 500],
        "equal": ["the very same text"] * 40,
        "one": ["alone"],
    }


def test_the_bound_is_never_under_the_mean(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_TEXTS", 70)
    rows = [(g, t) for g, own in texts_of(random.Random(4)).items() for t in own]
    df = spark.createDataFrame(rows, "grp string, text string")
    mean = {r["grp"]: r["similarity"] for r in similarity.average_likeness(df).collect()}
    most = {r["grp"]: r["most"] for r in similarity.greatest_likeness(similarity.weighed(df)).collect()}
    assert most.keys() == mean.keys() and all(most[g] >= mean[g] - 1e-12 for g in mean)
    assert most["hex"] < 0.08 and mean["hex"] == pytest.approx(0.06, abs=0.01)


def test_unlike_targets_are_settled_without_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(swarms, "BOUND_TEXTS", 50)
    rng = random.Random(5)
    rows = [(f"{g}{i}", f"u{i}", i * 500_000, g, t) for g, own in texts_of(rng).items() for i, t in enumerate(own)]
    first = kept(swarms.first_replies(spark.createDataFrame(rows, "id string, account_id string, at_us long, target string, text string")))
    real, compared = swarms.average_likeness, []
    monkeypatch.setattr(swarms, "average_likeness", lambda df: compared.append({r["grp"] for r in df.select("grp").distinct().collect()}) or real(df))
    whole, settled = (kept(swarms.swarm_index(first, measured)) for measured in (True, False))
    assert "hex" in compared[0] and "hex" not in compared[1] and "alike" in compared[1]
    kinds = lambda df: {(r["target"], r["authors"], r["swarm"]) for r in df.collect()}
    assert kinds(whole) == kinds(settled) and {s for _, _, s in kinds(whole)} == {True, False}
    own = spark.createDataFrame([(f"n{i}", f"u{rng.randrange(400)}", rng.randrange(40) * 500_000, rng.choice(["hex", "alike", "mixed", "unseen"]), rng.choice(["what a wonderful photo of it", "0123456789abcdef0123456789"])) for i in range(80)], "id string, account_id string, at_us long, target string, text string")
    added = [swarms.augmented(first, index, own).select("account_id", "target", "authors", "swarm", F.when(F.col("swarm"), F.round("similarity", 9))) for index in (whole, settled)]
    assert sorted(map(tuple, added[0].collect()), key=str) == sorted(map(tuple, added[1].collect()), key=str)
