"""Every query with SQL against DuckDB on the smallest tables, and operators at their edges."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from murmuration.functions import scores, text
from murmuration.operators import behaviour, graph, history
from murmuration.plans.oracle import ORACLE_SQL
from murmuration.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
HISTORY = "id string, account_id string, label_key string, value boolean, confidence_milli long, reason string, rule_version string, labeled_at timestamp_ntz"


@pytest.fixture(scope="module")
def views():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, views, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = views.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    for name in QUERIES.keys() - ORACLE_SQL.keys():
        assert QUERIES[name](spark, SF).count() >= 0


def rows(spark, *data):
    import datetime

    full = [(i, a, k, v, c, r, ver, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)) for i, a, k, v, c, r, ver, d in data]
    return spark.createDataFrame(full, HISTORY)


def test_latest_breaks_ties_by_id_and_changes_skip_a_first_false(spark):
    h = rows(spark, ("1", "a", "x", False, 1, "r", "1", 0), ("2", "a", "x", True, 2, "r", "1", 1), ("3", "a", "x", True, 3, "r", "1", 1), ("4", "a", "x", True, 3, "r", "2", 2), ("5", "a", "x", False, 3, "r", "2", 3))
    assert [r["id"] for r in history.latest(h.where("id < '4'")).collect()] == ["3"]
    assert [r["id"] for r in history.nth_latest(h, 2).collect()] == ["4"]
    assert sorted(r["id"] for r in history.compacted(h).collect()) == ["1", "2", "4", "5"]
    assert sorted((r["id"], r["change_type"]) for r in history.changes(h).collect()) == [("2", "added"), ("3", "updated"), ("5", "removed")]


def test_empty_history(spark):
    h = rows(spark).limit(0)
    assert history.latest(h).count() == history.distributions(h).count() == history.changes(h).count() == 0


def test_scores_at_their_edges(spark):
    df = spark.range(1)
    r = df.select(
        scores.ramp(F.lit(5.0), 5, 5).alias("a"), scores.ramp(F.lit(10.0), 5, 5).alias("b"), scores.ramp(F.lit(4.0), 5, 0).alias("c"), scores.ramp(F.lit(0.0), 5, 5, above=False).alias("d"),
        scores.decile_trigger(F.lit(1.0)).alias("e"), scores.posterior_at_least(F.lit(3), F.lit(10), 0.3).alias("p"), scores.posterior_at_least(F.lit(0), F.lit(5), 0.5).alias("q"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (0.5, 1.0, 0.0, 1.0, 9)
    tail = lambda s, n, t: sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(s + 1))
    assert r["p"] == pytest.approx(tail(3, 10, 0.3)) and r["q"] == pytest.approx(tail(0, 5, 0.5))


def test_text_functions(spark):
    df = spark.createDataFrame([("RT @a: Hi　there https://x.y/z #tag  END ",), ("",), ("あ",), ("aab",)], "t string")
    got = [r[0] for r in df.select(text.normalize_for_similarity(F.col("t"), True)).collect()]
    assert got[0] == "rt : hi there end"
    assert [sorted(r[0]) for r in df.select(text.bigrams(F.col("t"))).collect()][1:] == [[], ["あ"], ["aa", "ab"]]


def test_reconciliation_counts_up(spark):
    b = spark.createDataFrame([("a", "x", 0, True, True, "active"), ("a", "y", 2, False, True, "active"), ("a", "z", 1, False, True, "active"), ("a", "w", 1, False, False, "missing")], "blocker_id string, blocked_id string, missing_before long, seen boolean, complete boolean, status_before string")
    got = {r["blocked_id"]: (r["status"], r["missing_count"]) for r in graph.reconcile_blocks(b, F.col("seen"), F.col("complete")).collect()}
    assert got == {"x": ("active", 0), "y": ("resolved", 3), "z": ("missing", 2), "w": ("missing", 1)}


def test_sliding_window_includes_its_end(spark):
    day = behaviour.DAY_US
    t = spark.createDataFrame([(1, "a", 0, True, "p"), (2, "a", day, True, "q"), (3, "a", day + 1, True, "r"), (4, "a", 5, False, "s"), (5, "b", 0, True, None)], "id long, account_id string, at_us long, is_reply boolean, in_reply_to string")
    assert [tuple(r) for r in behaviour.sliding_targets(t).collect()] == [("a", 2, 2, 1)]


def test_without_the_training_data_part():
    """Nothing outside it imports it."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['murmuration.llm'] = None; import __spark_entry__ as e; assert 'label_snapshot' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_posterior_of_large_samples(spark):
    got = spark.range(1).select(scores.posterior_at_least(F.lit(700), F.lit(1100), 0.5).alias("a"), scores.posterior_at_least(F.lit(2520), F.lit(5000), 0.5).alias("b")).first()
    exact = sum(math.comb(5001, j) for j in range(2521)) / 2**5001
    assert got["a"] == pytest.approx(1.0, abs=1e-9) and got["b"] == pytest.approx(exact, rel=1e-9)


def test_label_changes_follow_confidence_and_reason(spark):
    h = rows(spark, ("1", "a", "x", False, 500, "r", "1", 0), ("2", "a", "x", False, 900, "r", "1", 1), ("3", "a", "x", False, 900, "r", "2", 2), ("4", "a", "x", False, 900, "s", "2", 3))
    assert sorted((r["id"], r["change_type"]) for r in history.changes(h).collect()) == [("2", "updated"), ("4", "updated")]


def test_drop_is_of_true_rows(spark):
    months = spark.createDataFrame([("x", "2024-01", 100, 50), ("x", "2024-02", 100, 10), ("x", "2024-03", 3, 0)], "label_key string, month string, evaluated long, true_count long")
    got = {r["month"]: (r["missing"], r["drop"], r["exceeded"]) for r in history.count_drops(months, 5, 0.2).collect()}
    assert got == {"2024-02": (False, 0.8, True), "2024-03": (True, 1.0, False)}


def test_copies_of_one_campaign_do_not_count(spark):
    t = spark.createDataFrame([("same long enough text here", a, g) for a, g in (("a", "1"), ("b", "1"))] + [("another long enough text", "a", "1"), ("another long enough text", "b", None)], "text string, account_id string, target string")
    assert {r["text"][:4]: r["others"] for r in behaviour.duplicate_replies(t).collect()} == {"same": 0, "anot": 1}
