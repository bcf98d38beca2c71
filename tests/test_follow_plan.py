"""Follow signals: edges are sent with their labels unexploded, and each edge's two directions come of one pass."""

import re

from pyspark.sql import functions as F

from murmuration.operators import graph


def test_labels_are_exploded_behind_the_shuffle(spark):
    history = spark.createDataFrame([("b", "x", True, "2020-01-01", "1"), ("b", "y", False, "2020-01-01", "2"), ("a", "x", None, "2020-01-01", "3")], "account_id string, label_key string, value boolean, labeled_at string, id string")
    follow = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "a")], "follower_id string, followee_id string")
    samples = spark.createDataFrame([("a", "b"), ("d", "b")], "account_id string, followee_id string")
    out = graph.follow_signals(follow, history)
    want = {("a", "x", 1, 1, 1, 1), ("a", "y", 1, 0, 1, 0), ("c", "x", 1, 1, 0, 0), ("c", "y", 1, 0, 0, 0), ("b", "x", 1, 0, 1, 0)}
    assert {tuple(r) for r in out.collect()} == want
    assert {tuple(r) for r in graph.follow_signals(follow, history, samples).collect()} == want | {("d", "x", 1, 1, 0, 0), ("d", "y", 1, 0, 0, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(labels.*?RebalancePartitions", plan, re.DOTALL) and not re.search(r"\bUnion\b", plan)
