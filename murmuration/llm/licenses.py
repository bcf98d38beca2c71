"""License scans by a positional index of rare words.

Templates (short phrases and longer notices) are indexed by word and position. How rare a word of theirs is,
is counted over the whole corpus. In each file the rarest word of a template's first key phrase is looked up: where it
stands gives the place that the template would have, the postings of the template's other words are
intersected by relative position, and a template counts only where all its key phrases stand.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of UTF-8 bytes: digits, small letters and all that isn't ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose every place counts, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Fixed values: (label, notice, key phrases in order); wording of the licences' own notices.
NOTICES = (
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license", "free software foundation")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses license 2 0")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose", "without fee is hereby granted")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
)
#: Words that a later key phrase may stand off its place, for what a file puts in or leaves out.
SLACK = 6

MATCH = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("score", pa.float64()), ("phrase", pa.bool_())])


class Template(NamedTuple):
    """words, first key phrase's rarest word and its place, key phrases as (place, words), weight of each word."""

    label: str
    phrase: bool
    words: list[bytes]
    rarest: bytes
    place: int
    keys: list[tuple[int, list[bytes]]]
    weights: list[float]


def vocabulary() -> list[str]:
    return sorted({w for text in (*PHRASES, *(n for _, n, _ in NOTICES)) for w in text.split()})


def _placed(words: list[bytes], key: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def index(rarity: dict[str, float]) -> dict[bytes, list[Template]]:
    """The templates by the word that is looked up for them."""
    out: dict[bytes, list[Template]] = {}
    idf = {w.encode(): rarity[w] for w in vocabulary()}
    for label, text, keys, phrase in [(v, k, (k,), True) for k, v in PHRASES.items()] + [(*n, False) for n in NOTICES]:
        words = text.encode().split()
        placed = [(_placed(words, k), k) for k in (x.encode().split() for x in keys)]
        at, first = placed[0]
        place = at + max(range(len(first)), key=lambda i: idf[first[i]])
        out.setdefault(words[place], []).append(Template(label, phrase, words, words[place], place, placed, [idf[w] for w in words]))
    return out


def rarities(texts: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each word of the templates, over all rows of `texts` (text); at least a little above 0."""
    words = F.split(F.translate("text", UPPER, LOWER), BETWEEN)
    own = F.array(*[F.lit(w) for w in vocabulary()])
    held = texts.select(F.explode(F.concat(F.array(F.lit("")), F.array_except(F.array_intersect(own, words), F.array(F.lit(""))))).alias("word"))  # the empty word counts rows
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # as many as the templates have words
    n = counts.get("", 0)
    return {w: math.log((n + 2) / (counts.get(w, 0) + 1)) for w in vocabulary()}


def _stands(words: list[bytes], key: list[bytes], at: int) -> bool:
    return at >= 0 and words[at : at + len(key)] == key


def matches(words: list[bytes], templates: dict[bytes, list[Template]]) -> list[dict]:
    """All places of all templates in a file's words, in order."""
    wanted = templates.keys() & set(words)
    if not wanted:
        return []
    found = []
    for pos, word in enumerate(words):
        if word not in wanted:
            continue
        for t in templates[word]:
            start = pos - t.place
            at, first = t.keys[0]
            if not _stands(words, first, start + at):
                continue
            if not all(any(_stands(words, key, start + place + off) for off in range(-SLACK, SLACK + 1)) for place, key in t.keys[1:]):
                continue
            inside = sum(x for i, (w, x) in enumerate(zip(t.words, t.weights)) if 0 <= start + i < len(words) and words[start + i] == w)
            found.append({"label": t.label, "start": max(0, start), "words": len(t.words), "score": min(1.0, inside / sum(t.weights)), "phrase": t.phrase})
    return sorted(found, key=lambda m: (m["start"], m["label"], m["words"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and matches (array of label, start, words, score, phrase): one row for each row of `docs`.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z; starts count words from 0, and a notice that is cut off at the front
    starts at 0. A match's score is the share of the template's words, weighed by rarity, that stand in their places: 1 for phrases. A null or
    empty text has no words and no match. Rows repeated whole have the same matches each; places that overlap all count. Texts are scanned whole,
    in time that grows with their length. An empty table gives an empty result. Columns but the two named are not looked at, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    templates = index(rarities(own))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column("text").to_pylist():
                words = WORD.findall(text.encode().lower())
                counts.append(len(words))
                found.append(matches(words, templates))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(MATCH))], names=["doc_id", "n_words", "matches"])

    id_type = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(each, f"doc_id {id_type}, n_words long, matches array<struct<label:string,start:long,words:int,score:double,phrase:boolean>>")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir)).withColumn("base", F.filter("matches", lambda m: m["phrase"]))
    listed = lambda col: F.array_join(F.array_sort(F.array_distinct(F.transform(col, lambda m: m["label"]))), ",")
    starts = F.transform("base", lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed("base").alias("base_labels"), listed("matches").alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
