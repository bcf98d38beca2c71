"""The pipeline's stages on a small corpus, each against a plain version on its own input."""

import os
import random
import re
from collections import Counter

import pytest
from helpers import DOCS, words
from test_near_duplicates import edited, plain_components, plain_removed
from test_operators import water_fill

import corpus_pipeline
from murmuration.llm import mixing


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    data = []
    for i in range(140):
        kind = rng.random()
        if kind < 0.2:
            text = "BUY!! " + " ".join(f"{w.upper()}!! ###" for w in words(rng, 20).split())
        elif kind < 0.4 and data:
            text = edited(rng, data[rng.randrange(len(data))][1], 0.02) if i else ""
        else:
            text = "\n".join(words(rng, rng.randint(5, 40), 10**6) for _ in range(rng.randint(1, 5)))
        data.append((i, text, "en", f"s{i % 3}", len(text)))
    data += [(200, "", "en", "s0", 0), (201, None, "en", None, None), data[3]]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(data, DOCS).write.parquet(os.path.join(d, "documents.parquet"))
    marked = [(i, int("!!" not in (t or "")), 0) for i, t, *_ in data if i < 140]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    return d, data


def test_rows_that_share_an_id_or_have_none(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(3, text, "en", "s", 0), (7, text, "en", "s", 0), (7, "only here in this one row", "en", "s", 0), (None, text, "en", "s", 0), (None, "", "en", "s", 0), (None, "", "en", "s", 0), (5, None, "en", "s", 0)]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(data, DOCS), "")
    assert Counter(map(tuple, kept.collect())) == Counter([data[0], data[2], *data[4:]])


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_plain_versions(spark, corpus):
    d, data = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "mixing", "bpe"]
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        before = tuples(docs)
        docs = stage(spark, docs, d)
        path = f"{d}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        done[name] = (before, tuples(docs))
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before, after = done["quality"]
    kept = {r[0] for r in after}
    held = [r for r in before if r[1]]
    assert sum((r[0] in kept) == ("!!" not in r[1]) for r in held) >= 0.97 * len(held)
    before, after = done["line_dedup"]
    gone = plain_removed(before)
    want = Counter()
    for r in before:
        lines = (r[1] or "").split("\n")
        rest = [x for i, x in enumerate(lines) if (r[0], i) not in gone]
        if len(rest) == len(lines):
            want[(r[0], r[1])] += 1
        elif any(x.strip() for x in rest):
            want[(r[0], "\n".join(rest))] += 1
    assert Counter((r[0], r[1]) for r in after) == want
    before, after = done["near_duplicates"]
    stay, held = Counter(), set()
    for r, (i, n, c) in zip(before, plain_components(before)):  # one row of each group, also of rows repeated whole
        if i == c and (n == 0 or c not in held):
            stay[r] += 1
            held.add(c)
    assert Counter(after) == stay
    before, after = done["mixing"]
    size = Counter()
    for r in before:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = water_fill(dict(size), mixing.WEIGHTS, mixing.BUDGET, mixing.MOST_EPOCHS)
    taken = Counter()
    for r in after:
        taken[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    longest = max(len((r[1] or "").split()) for r in before)
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    assert all(n <= 2 * Counter(before)[r] for r, n in Counter(after).items())
    before, after = done["bpe"]
    assert Counter(r[0] for r in before) == Counter(r[0] for r in after)
    again = tuples(corpus_pipeline.run(spark, d))
    assert again == after
