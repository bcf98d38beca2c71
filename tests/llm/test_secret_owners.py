"""Copies of a document aren't other owners of its secrets."""

from helpers import frame

from murmuration.llm import secrets

TOKEN = "Zx9" * 9


def spans(spark, data):
    return {r["doc_id"]: [(s["kind"], s["owners"], s["live"]) for s in r["spans"]] for r in secrets.scan(frame(spark, data, extra=True)).collect()}


def test_copies_of_a_text_are_one_owner_in_each_source(spark):
    text = f"use {TOKEN} here, password = {'hunter2' * 3}"
    data = [(i, text if i % 2 else text.replace("use", "USE"), "en", f"s{i // 4}", 0) for i in range(6)]
    got = spans(spark, data)
    assert all(got[i] == [(3, 2, True), (0, 2, True)] for i in range(6))


def test_one_bound_for_bare_and_named_candidates(spark):
    two, three = "Ab1" * 9, "Cd2" * 9
    data = [(i, f"text {i} has {two}", "en", "s", 0) for i in range(2)] + [(10 + i, f"text {i} has {three}", "en", "s", 0) for i in range(3)]
    got = spans(spark, data)
    assert got[0] == got[1] == [(3, 2, True)]
    assert got[10] == got[11] == got[12] == []


def test_bare_tokens_have_no_upper_length(spark):
    got = spans(spark, [(1, f"a {TOKEN * 40} b", "en", "s", 0), (2, "a " + "z" * 300 + "Q7 b", "en", "s", 0), (3, "a " + "z" * 300 + " b", "en", "s", 0)])
    assert got == {1: [(3, 1, True)], 2: [(3, 1, True)], 3: []}
