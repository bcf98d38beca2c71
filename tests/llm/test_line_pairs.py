"""Lines that are not alike make hardly any pairs, whatever the number of their words."""

import random

from helpers import frame
from test_line_words import plain_removed_by_words, removed, word_docs

from murmuration.llm import line_dedup


def test_long_lines_of_the_same_words_make_no_pairs(spark, monkeypatch):
    rng, made = random.Random(5), {}
    vocabulary = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(rng.sample(vocabulary, n)), "en", "s", 0) for i, n in enumerate([120] * 60 + [150] * 60)]
    data.append((200, data[100][1] + " more", "en", "s", 0))
    spool = line_dedup.spool
    monkeypatch.setattr(line_dedup, "spool", lambda df, name: made.setdefault(name, spool(df, name)))
    line_dedup.removed_lines(frame(spark, data, extra=True))
    assert made["firsts"].count() + made["others"].count() <= 3


def test_long_and_short_lines_meet(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG", 20)
    assert removed(spark, word_docs(6)) == plain_removed_by_words(word_docs(6))
