"""License scans against a plain search for phrases and notices, and the awkward tables."""

import math
import random
import re

import pytest
from helpers import DOCS, frame, rows

from murmuration.llm import licenses

LINES = (
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "GNU GENERAL PUBLIC\nLICENSE", "cc by cc by cc by", "cc-by", "ccby", "MIT licensed", "apache éLicense", "the Apache  License apache license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of some other software and documentation files of it, to deal in the Software without restriction",
    "permission is hereby granted free of charge to whoever asks", "is hereby granted, free of charge",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "free software foundation", "mit license " * 400, "license mit license", "gnu general public", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
)


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts):
    """(n_words, n_base, first, last, base labels, labels, score) of each text, by looking at every place."""
    files = [words_of(t) for t in texts]
    df = {w: sum(w in set(f) for f in files) for w in licenses.vocabulary()}
    idf = {w: math.log((len(files) + 2) / (n + 1)) for w, n in df.items()}
    out = []
    for words in files:
        base, labels, score = [], set(), 0.0
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            starts = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            base += [(i, label) for i in starts]
            score = 1.0 if starts else score
        labels |= {label for _, label in base}
        for label, notice, keys in licenses.NOTICES:
            n = notice.split()
            spots = [next(i for i in range(len(n)) if n[i : i + len(k)] == k) for k in (x.split() for x in keys)]
            for start in range(-len(n), len(words)):
                near = [[start + s + off for off in ([0] if j == 0 else range(-licenses.SLACK, licenses.SLACK + 1))] for j, s in enumerate(spots)]
                if all(any(i >= 0 and words[i : i + len(k.split())] == k.split() for i in places) for places, k in zip(near, keys)):
                    labels.add(label)
                    score = max(score, sum(idf[w] for i, w in enumerate(n) if 0 <= start + i < len(words) and words[start + i] == w) / sum(idf[w] for w in n))
        starts = [i for i, _ in base]
        out.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), round(min(1.0, score), 9)))
    return out


@pytest.fixture(scope="module")
def table():
    rng, out = random.Random(3), rows(seed=9, n=30)
    for i, line in enumerate(LINES):
        out += [(5000 + i, line, "en", "s", 0), (6000 + i, f"{out[i][1] or ''} {line}\n{rng.choice(LINES)} {out[i + 1][1] or ''}", "en", None, 0)]
    return [*out, (None, LINES[0], None, None, None), out[-1], out[-1]]


def test_query_equals_a_plain_search(spark, table, tmp_path):
    frame(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op13_licenses(spark, str(tmp_path)).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    mine = sorted((repr(r["doc_id"]), *(repr(r[k]) for k in names), round(r["score"], 9)) for r in got)
    assert mine == sorted((repr(r[0]), *map(repr, p[:-1]), p[-1]) for r, p in zip(table, plain([r[1] for r in table])))
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["labels"] == "cc-by,cc-by-nc-4.0" and by[5001]["labels"] == "apache,apache-2.0" and by[5003]["labels"] == "gpl,gpl-3.0"
    assert by[5011]["labels"] == by[5012]["labels"] == "mit" and 0.5 < by[5012]["score"] < by[5011]["score"] == 1 and by[5013]["labels"] == ""
    assert (by[5005]["n_base"], by[5017]["n_base"], by[5010]["last_word"]) == (3, 400, 3)


def test_key_phrases_may_be_a_little_off_their_place(spark):
    texts = ["permission is hereby granted free of charge " + "w " * n + "deal in the software without restriction" for n in (9, 10, 22, 23)]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [len(r["matches"]) for r in sorted(got)] == [0, 1, 1, 0]


def test_empty_table_and_clashing_names(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []
    df = frame(spark, extra=True).selectExpr("*", "1 AS words", "2 AS matches", "3 AS n_words", "4 AS base")
    assert sorted(map(str, licenses.scan(df).collect())) == sorted(map(str, licenses.scan(frame(spark)).collect()))
