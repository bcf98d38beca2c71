"""A small table with the awkward cases, and plain versions of what operators compute."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(1, 6))) + str(rng.randrange(vocabulary) % 7) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += [None, "", " ", "x", texts[0], texts[0].upper(), texts[1] + " tail", "a" * 5000, words(rng, 5000), "é😀 ü　z\n\n\x0b\x1c", texts[2]]
    shared = words(rng, 40)
    texts += [shared + " " + words(rng, 3) for _ in range(12)]
    out = [(i, t, "en", None if i % 11 == 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return out


def frame(spark, data=None, extra=False):
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    if extra:
        df = df.selectExpr("*", "1 AS size", "'x' AS shard", "2 AS node", "3 AS score", "4 AS taken", "5 AS key", "6 AS n", "7 AS label")
    return df
