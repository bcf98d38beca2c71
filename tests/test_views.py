"""Read views and pages by key at their edges."""

import base64
import json
import random

from pyspark.sql import functions as F

from murmuration.operators import views

ROW = "id string, rank int, at long"


def walked(rows, keys, limit, filters="f"):
    out, cursor = [], None
    while True:
        found, cursor = views.page(rows, keys, limit, cursor, filters)
        out += [r["id"] for r in found]
        if cursor is None:
            return out


def test_pages_hold_every_row_once(spark):
    rng = random.Random(1)
    data = [(f"é{i:02d}", rng.choice([None, 0, 1, 2]), rng.choice([None, 5, 6])) for i in range(41)]
    rows = spark.createDataFrame(data, ROW).coalesce(1).cache()
    keys = (views.Key("rank", True), views.Key("at"), views.Key("id", True))
    big = 10**9
    want = [r[0] for r in sorted(data, key=lambda r: (big if r[1] is None else -r[1], big if r[2] is None else r[2], [-ord(c) for c in r[0]]))]
    assert walked(rows, keys, 7) == want == walked(rows, keys, 50)
    assert walked(rows.limit(0), keys, 7) == [] and len(views.page(rows, keys, 41)[0]) == 41 and views.page(rows, keys, 41)[1] is None


def test_cursors_of_other_filters_or_shapes_are_none():
    good = views.encoded((3, None, "é"), "f")
    assert "=" not in good and views.decoded(good, "f") == ["3", "", "é"] and views.decoded(good, "g") is None
    made = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode()
    for bad in (None, "", "%%%", "abc", made([1]), made({"sortValues": "x", "filterHash": "f"}), made({"sortValues": [1, 2], "filterHash": "f"}), made({"filterHash": "f"})):
        assert views.decoded(bad, "f") is None
    assert views.decoded(made({"sortValues": ["1"], "filterHash": "f"}), "f") == ["1"]


def test_filters_tell_their_order_apart_from_nothing(spark):
    rows = spark.createDataFrame([("a", "active", "low"), ("b", "resolved", "high"), ("c", "recurring", "critical"), ("d", "active", "odd")], "id string, status string, severity string")
    found, told = views.filtered(rows, None, ("critical", "low"))
    assert {r["id"]: r["severity_rank"] for r in found.collect()} == {"a": 0, "c": 3} and told == views.filtered(rows, ("recurring", "active"), ("low", "critical"))[1]
    assert [r["id"] for r in views.filtered(rows, ("resolved",), status_none=None)[0].collect()] == ["b"]


def test_histories_skip_the_newest_and_are_cut(spark):
    data = [("a", "x", f"{i:03d}", i) for i in range(30)] + [("a", "y", "900", -1), ("b", "x", "1", 1)]
    rows = spark.createDataFrame(data, "account_id string, label_key string, id string, labeled_at long")
    got = views.label_histories(rows, most_rows=25, entries=4).collect()
    assert sorted((r["place"], r["id"]) for r in got) == [(1, "028"), (2, "027"), (3, "026"), (4, "025")]


def test_label_heads_and_list(spark):
    rows = spark.createDataFrame([("1", "x", 1, 4, 2, "complete"), ("2", "x", 2, 9, 9, "partial"), ("3", "y", 1, 0, 0, "complete"), ("4", "z", 1, 5, 5, "unknown")], "id string, label_key string, at long, evaluated long, true_count long, completeness string")
    got = {r["label_key"]: (r["id"], r["prevalence"], r["failed"]) for r in views.label_heads(rows).collect()}
    assert got == {"x": ("1", 0.5, True), "y": ("3", 0.0, False), "z": (None, None, True)}
    listed = spark.createDataFrame([("a", "normal", 0, 0.9), ("b", "attention", 2, 0.1), ("c", "watch", 0, 0.1), ("d", "unknown", 5, 0.1), ("e", "normal", 0, 0.9)], "label_key string, quality string, active_findings long, prevalence double")
    assert [r["label_key"] for r in views.label_list(listed).orderBy("place").collect()] == ["c", "d", "b", "a", "e"]


def test_details_relations_and_redaction(spark):
    found = spark.createDataFrame([("f",), ("g",)], "id string")
    seen = spark.createDataFrame([(i, "f", i % 3) for i in range(12)], "id long, finding_id string, observed_at long")
    rows = views.finding_details(found, seen, 2).collect()
    assert sorted((r["id"], r["occurrence_id"] or -1, r["place"] or 0) for r in rows) == [("f", 8, 2), ("f", 11, 1), ("g", -1, 0)]
    edges = spark.createDataFrame([("a", x, s) for x, s in (("p", 1), ("q", 2), ("r", 2))], "o string, x string, s int")
    assert tuple(views.relations(edges, "o", "x", "s", 2).first()) == ("a", 3, ["q", "r"])
    texts = spark.createDataFrame([("é" * 201 + "\nmore",), ("é" * 200,), ("\nx",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in texts.select(views.redacted(F.col("t"))).collect()] == ["é" * 200 + "…", "é" * 200, "", None]
