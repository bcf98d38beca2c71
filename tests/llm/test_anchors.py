"""Likeness of documents by all their anchors and where these stand, against brute force."""

import random

import pytest
from helpers import frame, rows, words

from murmuration.llm import fingerprints


def agreed(a, b):
    """Hashes of anchors that have the same neighbour at the same distance in both."""

    def near(x):
        first = {(h, -1, p) for h, p in x[:1]}
        return first | {(h, g, p - q) for (g, q), (h, p) in zip(x, x[1:])}, {(h, g, q - p) for (h, p), (g, q) in zip(x, x[1:])}

    return {k[0] for x, y in zip(near(a), near(b)) for k in x & y}


def plain_likeness(a, b):
    union = {h for h, _ in a} | {h for h, _ in b}
    return len(agreed(a, b)) / len(union) if union else 1.0


def likeness_of(spark, texts):
    df = fingerprints.fingerprint(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).select("doc_id", "fingerprint")
    both = df.selectExpr("doc_id i", "fingerprint a").crossJoin(df.selectExpr("doc_id j", "fingerprint b"))
    return {(r["i"], r["j"]): r for r in both.select("i", "j", "a", "b", fingerprints.likeness("a", "b").alias("x")).collect()}


def test_likeness_against_brute_force(spark):
    texts = [r[1] for r in rows(n=12)]
    got = likeness_of(spark, [*texts, texts[3] + " " + texts[4], (texts[5] + " ") * 3])
    for r in got.values():
        a, b = ([(x["hash"], x["position"]) for x in r[c]] for c in "ab")
        assert r["x"] == pytest.approx(plain_likeness(a, b))
    assert all(got[i, i]["x"] == 1.0 for i, _ in got)


def test_a_short_passage_in_long_texts_leaves_a_trace(spark):
    rng = random.Random(9)
    passage = words(rng, 50, 10**6)
    a, b, c = (words(rng, n, 10**6) for n in (6000, 5000, 4000))
    got = likeness_of(spark, [f"{a} {passage} {b}", f"{c} {passage} {words(rng, 7000, 10**6)}", f"{a} {b}"])
    assert len(got[0, 0]["a"]) > 4000
    assert len(got[0, 1]["a"]) * got[0, 1]["x"] > 5
    # A small change in a long text shows.
    assert 0.99 < got[0, 2]["x"] < 1
