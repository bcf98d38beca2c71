"""Line dedup by word sets, against brute force."""

import random
import re

from helpers import frame, words
from test_near_duplicates import edited, line_docs

from murmuration.llm import line_dedup


def word_set(line):
    return set(re.findall(r"[^ \t\n\x0b\f\r]+", line.lower()))


def plain_removed_by_words(data):
    places = sorted((r[0], i, x) for r in data if r[0] is not None for i, x in enumerate((r[1] or "").split("\n")))
    sets = [(d, i, word_set(x)) for d, i, x in places if word_set(x)]
    out = set()
    for k, (d, i, s) in enumerate(sets):
        for e, j, t in sets[:k]:
            if (e, j) < (d, i) and 100 * len(s & t) >= 80 * len(s | t):
                out.add((d, i))
                break
    return out


def word_docs(seed=3):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(5, 40), 10**6) for _ in range(30)]
    out = line_docs()
    for i in range(100, 140):
        picks = [edited(rng, rng.choice(base), rng.choice([0, 0.05, 0.15])) if rng.random() < 0.6 else words(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 8))]
        out.append((i, "\n".join(picks), "en", "s", 0))
    return out + [(200, "FIVE two three four one", "en", "s", 0), (200, "an other text of the same id", "en", "s", 0), (201, "an other text of that same id", "en", "s", 0)]


def removed(spark, data):
    return {(r["doc"], r["line"]) for r in line_dedup.removed_lines(frame(spark, data, extra=True)).collect()}


def test_lines_by_word_sets_against_brute_force(spark):
    data = word_docs() + [word_docs()[2]] * 2
    assert removed(spark, data) == plain_removed_by_words(data)


def test_lines_that_meet_on_pairs_of_words(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", 1)
    monkeypatch.setattr(line_dedup, "BUCKETS", 1 << 10)
    assert removed(spark, word_docs(4)) == plain_removed_by_words(word_docs(4))


def test_lines_of_rows_without_an_id_come_first(spark):
    data = [(None, "one two three", "en", "s", 0), (1, "One two three\nother words", "en", "s", 0), (1, "one two three", "en", "s", 0), (None, "one two three", "en", "s", 0)]
    assert removed(spark, data) == {(1, 0)}
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(frame(spark, data)).collect())
    assert kept == [(0, "one two three"), (0, "one two three"), (1, "other words")]


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    data = [(1, "a b c d e f", "en", "s", 0), (2, "A b c d e f\nx", "en", "s", 0), (2, "quite another line\ny", "en", "s", 0)]
    kept = sorted(r["text"] for r in line_dedup.dedup_lines(frame(spark, data)).collect())
    assert kept == ["a b c d e f", "quite another line\ny", "x"]


def test_one_changed_word_in_the_middle(spark):
    w = [f"w{i}" for i in range(30)]
    data = [(1, " ".join(w), "en", "s", 0), (2, " ".join([*w[:15], "other", *w[16:]]), "en", "s", 0)]
    assert removed(spark, data) == {(2, 0)}


def test_short_lines_that_repeat_go(spark):
    data = [(1, "Home\n \nRead more", "en", "s", 0), (2, "home\n\nread  MORE\nmore words", "en", "s", 0), (3, "a b c d\nhome", "en", "s", 0), (4, "a b c d e\n ", "en", "s", 0)]
    assert removed(spark, data) == {(2, 0), (2, 2), (3, 1), (4, 0)}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, data)).collect()}
    assert kept == {1: data[0][1], 2: "\nmore words", 3: "a b c d"}
