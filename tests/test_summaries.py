"""As-of joins, merges by groups of columns, and tables that streams keep up, against plain Python."""

import os
import random

import pytest

from murmuration.operators import asof, upserts
from murmuration.streaming import counts, generations
from murmuration.streaming.guard import keep_newest

LEFT, RIGHT = "k string, j int, at long, n int", "k string, j int, at long, id int, v string"


def tables(seed=1, n=150):
    rng = random.Random(seed)
    some = lambda: (rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([1, 2, None]), rng.choice([None, *range(0, 120, 3)]))
    left = [(*some(), i) for i in range(n)]
    return left, [(*some(), i, rng.choice("xyz")) for i in range(n)]


def plain_as_of(left, right, strict, tolerance):
    out = {}
    for k, j, at, n in left:
        ok = [r for r in right if r[0] == k and r[1] == j and at is not None and r[2] is not None and (r[2] < at if strict else r[2] <= at)]
        best = max(ok, key=lambda r: (r[2], r[3]), default=None)
        out[n] = best[3] if best and (tolerance is None or at - best[2] <= tolerance) else None
    return out


@pytest.mark.parametrize("strict,tolerance,stretch", [(False, None, 1000), (True, None, 10), (False, 4, 7), (True, 0, 1)])
def test_as_of_equals_a_plain_search(spark, strict, tolerance, stretch):
    left, right = tables()
    rows = asof.as_of(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k", "j"], order=("id",), strict=strict, tolerance=tolerance, stretch=stretch)
    assert {r["n"]: r["found"] and r["found"]["id"] for r in rows.collect()} == plain_as_of(left, right, strict, tolerance)


def test_as_of_has_no_range_join(spark):
    left, right = (spark.createDataFrame(t, s) for t, s in zip(tables(), (LEFT, RIGHT)))
    plan = asof.as_of(left, right, ["k", "j"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert asof.as_of(left.limit(0), right, ["k", "j"]).count() == 0 and asof.as_of(left, right.limit(0), ["k", "j"]).where("found IS NOT NULL").count() == 0


SNAPSHOT = "id string, label_key string, at long, evaluated long, true_count long, completeness string"


def test_label_summary(spark):
    day = asof.DAY_MS
    seen = [("a0", "x", 0, 10, 1, "complete"), ("a1", "x", 6 * day, 10, 9, "partial"), ("a2", "x", 6 * day + 1, 0, 0, "complete"), ("a3", "x", 7 * day, 10, 5, "complete"), ("b", "y", 7 * day, 10, 5, "unknown"), ("c", "z", 7 * day, 4, 1, "partial"), ("d", "w", 5, 4, 1, "complete")]
    found = [(1, "x", "active", "low"), (2, "x", "recurring", "strange"), (3, "x", "resolved", "critical"), (5, "w", "active", "medium"), (4, "w", "active", "high"), (6, "w", "active", "high")]
    rows = spark.createDataFrame(seen, SNAPSHOT)
    got = {r["id"]: r for r in asof.label_summary(rows.where("id IN ('a3', 'b', 'c', 'd')"), rows, spark.createDataFrame(found, "id long, label_key string, status string, severity string")).collect()}
    r = got["a3"]
    assert (r["previous_delta"], r["day_delta"], r["week_delta"]) == (0.5, pytest.approx(0.4), pytest.approx(0.4))
    assert (r["active_findings"], r["highest_severity"], r["quality"]) == (2, "low", "attention")
    assert [got[i]["quality"] for i in "bcd"] == ["unknown", "watch", "attention"] and got["d"]["highest_severity"] == "high"
    assert got["b"]["week_delta"] is None and got["d"]["previous_delta"] is None and got["c"]["active_findings"] == 0


def test_merge_by_groups_of_columns(spark):
    groups = {"p_at": ("name",), "l_at": ("labels", "n")}
    schema = "id string, name string, p_at long, labels string, n int, l_at long"
    stored = spark.createDataFrame([("a", "old", 5, "x", 1, 9), ("b", "old", 5, "x", 1, None), ("c", "old", 5, None, None, None)], schema)
    late = [("a", "new", 6, "y", 2, 8, 1), ("b", "older", 4, "y", 2, None, 1), ("b", "same", 5, "z", 3, None, 2), ("d", None, 1, "w", 0, 1, 1), ("a", "newest", 7, None, None, None, 3), ("a", "between", 6, "q", 4, 9, 2)]
    got = {r["id"]: tuple(r)[1:] for r in upserts.by_group(stored, spark.createDataFrame(late, schema + ", seq long"), "id", groups, "seq").collect()}
    assert got == {"a": ("newest", 7, "q", 4, 9), "b": ("same", 5, "z", 3, None), "c": ("old", 5, None, None, None), "d": (None, 1, "w", 0, 1)}


ROW = "account_id string, label_key string, value boolean, confidence_milli long, rule_version string, reason string, labeled_us long, id string"


def plain_counts(rows):
    latest = {}
    for r in rows:
        if (r[0], r[1]) not in latest or latest[r[0], r[1]][6:] <= r[6:]:
            latest[r[0], r[1]] = r
    out = {}
    for (_, label), r in latest.items():
        for kind, name, milli in counts.cells(r[2:]):
            n, m = out.get((label, kind, name), (0, 0))
            out[label, kind, name] = n + 1, m + milli
    return out


def test_streamed_counts_equal_the_batch_after_each_batch_and_a_restart(spark, tmp_path):
    rng, seen = random.Random(2), []
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    for number in range(4):
        new = [(f"a{rng.randrange(6)}", rng.choice("xy"), rng.random() < 0.6, rng.choice([0, 299, 1000, 555]), rng.choice(["1", "2"]), rng.choice("pq"), rng.randrange(9) * 40_000_000, f"r{number}{i:02d}") for i in range(25)]
        new += seen[3:4]  # one that came before
        seen += new
        spark.createDataFrame(new, ROW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], ROW).schema).parquet(source)
        counts.keep_counts(stream, folder).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()  # a new query each time
        got = {tuple(r[:3]): tuple(r[3:]) for r in generations.newest(spark, folder, "label_key string, kind string, name string, n long, milli long").collect()}
        assert got == plain_counts(seen)


def test_only_touched_buckets_are_rewritten_and_a_batch_can_run_again(spark, tmp_path):
    schema = "k string, at long"
    out = str(tmp_path)
    merge = lambda stored, new: upserts.guarded(stored, new, ("k",), ("at",))

    def put(number, *rows):
        generations.rewrite(spark.createDataFrame(rows, schema), number, out, ("k",), spark.createDataFrame([], schema).schema, merge, buckets=16)

    def table():
        return {tuple(r) for r in generations.newest(spark, out, schema).collect()}

    put(0, *[(f"k{i}", 1) for i in range(40)])
    put(1, ("k1", 5), ("k2", 0))
    put(1, ("k1", 5), ("k2", 0))
    assert table() == {(f"k{i}", 5 if i == 1 else 1) for i in range(40)}
    assert 1 <= len([b for b in os.listdir(f"{out}/rows/batch=1") if b.startswith("bucket")]) <= 2 < len(os.listdir(f"{out}/rows/batch=0"))
    for n in range(2, 6):
        put(n, ("k1", 5 + n))
    assert ("k1", 10) in table() and len(table()) == 40
    left = [f"{n}/{b}" for n in os.listdir(f"{out}/rows") for b in os.listdir(f"{out}/rows/{n}") if b.startswith("bucket")]
    assert len(left) <= len({b.split("/")[1] for b in left}) + 1 and sorted(os.listdir(f"{out}/lists")) == ["batch=4", "batch=5"]  # two generations
    assert generations.newest(spark, str(tmp_path / "nothing"), schema).count() == 0


def test_a_repeated_stream_of_late_rows(spark, tmp_path):
    schema = "k string, at long, v string"
    for rows in ([("a", 5, "x")], [("a", 4, "late"), ("b", 1, "y")], [("a", 5, "later of the same time")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        keep_newest(stream, f"{tmp_path}/out", ("k",), ("at", "v")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in generations.newest(spark, f"{tmp_path}/out", schema).collect()} == {("a", 5, "x"), ("b", 1, "y")}
